"""Prefix scans over ranges against plain Python, with a busy key, nulls and ties, and their plan."""

import random

import pytest
from pyspark.sql import functions as F

from starloom.operators import prefix
from tests.conftest import rows


@pytest.fixture(scope="module")
def busy(spark):
    """One key holds half of the rows; a null key; keys of one row."""
    rng = random.Random(8)
    data = [("hot" if i % 2 else rng.choice(["a", "b", None, f"s{i}"]), i, rng.randrange(1000)) for i in range(900)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, pos long, v long").repartition(6)


@pytest.fixture(autouse=True, params=[2, 7, 40])
def ranges(spark, request):
    """Fixed numbers of ranges: few, some, and more than there are keys."""
    held = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def brute(data, fn):
    out = {}
    for k in {d[0] for d in data}:
        ordered = sorted((d for d in data if d[0] == k), key=lambda d: d[1])
        for i, d in enumerate(ordered):
            out[d[1]] = fn(ordered, i)
    return out


def test_all_scans(busy):
    data, df = busy
    got = lambda out: {r.pos: r.x for r in out.collect()}
    assert got(prefix.row_numbers(df, ["k"], ["pos"], "x")) == brute(data, lambda rs, i: i + 1)
    assert got(prefix.previous_max(df, ["k"], ["pos"], F.col("v"), "x")) == brute(data, lambda rs, i: max((d[2] for d in rs[:i]), default=None))
    assert got(prefix.running_sum(df, ["k"], ["pos"], F.col("v"), "x")) == brute(data, lambda rs, i: sum(d[2] for d in rs[:i + 1]))
    assert got(prefix.next_value(df, ["k"], ["pos"], "v", "x")) == brute(data, lambda rs, i: rs[i + 1][2] if i + 1 < len(rs) else None)
    assert got(prefix.previous_value(df, ["k"], ["pos"], "v", "x")) == brute(data, lambda rs, i: rs[i - 1][2] if i else None)


def test_null_values_are_values(spark):
    df = spark.createDataFrame([("a", i, None if i % 3 else i) for i in range(60)], "k string, pos long, v long")
    got = {r.pos: r.x for r in prefix.previous_value(df, ["k"], ["pos"], "v", "x").collect()}
    assert got == {i: (None if i == 0 or (i - 1) % 3 else i - 1) for i in range(60)}


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "k string, pos long, v long, other array<int>")
    out = prefix.running_sum(df, ["k"], ["pos"], F.col("v"), "x")
    assert out.columns == ["k", "pos", "v", "other", "x"] and out.collect() == []


def test_a_busy_key_is_split_and_the_input_moves_twice(busy, ranges):
    _, df = busy
    table = prefix.ranged(df, ["k"], ["pos"])
    sizes = [r["count"] for r in table.groupBy("_part").count().collect()]
    assert len(sizes) > ranges // 2 and max(sizes) <= 3 * 900 / len(sizes)
    assert table.where("k = 'hot'").select("_part").distinct().count() >= ranges // 3
    plan = prefix.row_numbers(df, ["k"], ["pos"], "x")._jdf.queryExecution().executedPlan().toString()
    # The input was dealt out when the ranges were written; here only the ranges are read, and their detail rows move once.
    assert "Scan ExistingRDD" not in plan and plan.count("SortMergeJoin") == 0
    assert sum("Exchange hashpartitioning(_here" in line for line in plan.splitlines()) <= 2


def test_ties_of_several_order_columns(spark):
    data = [("a", i // 10, i % 10) for i in range(100)]
    df = spark.createDataFrame(data, "k string, p long, q long")
    got = rows(prefix.row_numbers(df, ["k"], ["p", "q"], "n"))
    assert sorted(r[3] for r in got) == list(range(1, 101)) and all(n == p * 10 + q + 1 for _, p, q, n in got)
