import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import aggregates as a
from starloom.operators import joins as j
from starloom.operators import quality as q
from starloom.operators import sets as s
from starloom.operators import windows as w
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows."""
    rng = random.Random(3)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(9)}", i, rng.randrange(1000), rng.randrange(50)) for i in range(600)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, pos long, v long, g long").cache()


def slices():
    return F.floor(F.col("pos") / 40)


def brute(data, fn):
    out = {}
    for k in {d[0] for d in data}:
        ordered = sorted((d for d in data if d[0] == k), key=lambda d: d[1])
        for i, d in enumerate(ordered):
            out[d[1]] = fn(ordered, i)
    return out


def test_row_numbers(skewed):
    data, df = skewed
    got = {r.pos: r.n for r in w.row_numbers(df, ["k"], ["pos"], slices(), "n").collect()}
    assert got == brute(data, lambda rs, i: i + 1)


def test_previous_max(skewed):
    data, df = skewed
    got = {r.pos: r.m for r in w.previous_max(df, ["k"], ["pos"], F.col("v"), slices(), "m").collect()}
    assert got == brute(data, lambda rs, i: max((d[2] for d in rs[:i]), default=None))


def test_neighbours(skewed):
    data, df = skewed
    after = {r.pos: r.x for r in w.next_value(df, ["k"], ["pos"], "v", slices(), "x").collect()}
    before = {r.pos: r.x for r in w.previous_value(df, ["k"], ["pos"], "v", slices(), "x").collect()}
    assert after == brute(data, lambda rs, i: rs[i + 1][2] if i + 1 < len(rs) else None)
    assert before == brute(data, lambda rs, i: rs[i - 1][2] if i else None)


@pytest.mark.parametrize("percent", [0, 25, 50, 90, 100])
def test_percentile_matches_numpy(skewed, percent):
    data, df = skewed
    got = {r.k: r.p for r in a.percentile_exact(df, ["k"], "v", percent, "p", buckets=7).collect()}
    want = {k: float(np.percentile([d[2] for d in data if d[0] == k], percent)) for k in got}
    assert got == pytest.approx(want)


def test_percentile_of_the_whole_table(skewed):
    data, df = skewed
    assert a.percentile_exact(df, [], "v", 50, "p").first().p == pytest.approx(float(np.median([d[2] for d in data])))


def test_positions_and_order_mismatch(spark):
    df = spark.createDataFrame([(i, (i * 7) % 11) for i in range(11)], "id long, v long")
    placed = s.with_position(df, ["v", "id"], F.floor(F.col("v") / 3))
    assert {r.id: r.position for r in placed.collect()} == {i: (i * 7) % 11 + 1 for i in range(11)}
    swapped = placed.withColumn("position", F.when(F.col("position") == 1, 2).when(F.col("position") == 2, 1).otherwise(F.col("position")))
    assert s.order_mismatches(placed, swapped, ["id"]).count() == 2


def test_overlap_open_end_and_touching(spark):
    hist = spark.sql("""SELECT * FROM VALUES ('a', DATE '2024-01-01', DATE '2024-02-01', 's'), ('a', DATE '2024-02-01', CAST(NULL AS DATE), 't'),
      ('b', DATE '2024-01-01', CAST(NULL AS DATE), 's'), ('b', DATE '2024-05-01', DATE '2024-06-01', 't') h(k, f, t, seg)""")
    bad = q.overlapping_intervals(hist.unionByName(hist), ["k"], "f", "t", w.time_slice("f", "month"))
    assert [(r.k, r.seg) for r in bad.collect()] == [("b", "t")]


def test_overlap_within_a_day(spark):
    hist = spark.sql("""SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-02 12:00:00', 's'), ('a', TIMESTAMP_NTZ '2024-01-02 06:00:00', CAST(NULL AS TIMESTAMP_NTZ), 't'),
      ('b', TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-02 06:00:00', 's'), ('b', TIMESTAMP_NTZ '2024-01-02 06:00:00', CAST(NULL AS TIMESTAMP_NTZ), 't') h(k, f, t, seg)""")
    bad = q.overlapping_intervals(hist, ["k"], "f", "t", w.time_slice("f", "month"))
    assert [(r.k, r.seg) for r in bad.collect()] == [("a", "t")]


@pytest.mark.parametrize("how", ["plain", "periods", "ordered"])
def test_as_of_join(spark, how):
    hist = spark.sql("SELECT * FROM VALUES ('a', 10, 20, 'x'), ('a', 20, CAST(NULL AS INT), 'y'), ('b', 5, 6, 'z') h(k, valid_from, valid_to, seg)")
    fact = spark.createDataFrame([("a", 9), ("a", 10), ("a", 19), ("a", 20), ("a", 500), ("b", 6), ("c", 1)], "k string, at int")
    period = None if how == "plain" else (lambda c: F.floor(c / 7))
    out = (j.join_as_of_sliced if how == "ordered" else j.join_as_of)(fact, hist, ["k"], "at", period)
    assert {(r.k, r["at"]): r.seg for r in out.collect()} == {("a", 9): None, ("a", 10): "x", ("a", 19): "x", ("a", 20): "y", ("a", 500): "y", ("b", 6): None, ("c", 1): None}


def test_distinct_on_undoes_fanout_and_marks_ambiguity(spark):
    fan = spark.createDataFrame([("g", 1, 100), ("g", 1, 100), ("g", 2, 50), ("g", 3, 1), ("g", 3, 2)], "g string, k long, v long")
    assert a.distinct_on(fan.where("k < 3"), ["g"], "k", "v", "sum", "s").first().s == 150
    assert rows(a.once_per_key(fan, ["g"], "k", "v").where("is_ambiguous").select("k")) == [(3,)]
    with pytest.raises(Exception, match="differs within one"):
        a.distinct_on(fan, ["g"], "k", "v", "sum", "s").collect()


def test_fanout_safe_totals_differ_from_the_naive_join(spark):
    orders = spark.createDataFrame([(1, 500), (2, 300)], "o long, ship long")
    lines = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "o long, amt long")
    returns = spark.createDataFrame([(1, 3), (1, 4)], "o long, ref long")
    naive = orders.join(lines, "o").join(returns, "o", "left").agg(F.sum("amt"), F.sum("ref")).first()
    safe = orders.join(lines.groupBy("o").agg(F.sum("amt").alias("amt")), "o", "left").join(returns.groupBy("o").agg(F.sum("ref").alias("ref")), "o", "left").agg(F.sum("amt"), F.sum("ref")).first()
    assert tuple(naive) == (65, 14) and tuple(safe) == (35, 7)


def test_lists_of_any_length_stay_in_rows(spark):
    df = spark.createDataFrame([("g", i % 12_000) for i in range(13_000)] + [("h", None)], "g string, v long")
    got = a.listed_values(df, ["g"], "v")
    assert got.count() == 12_000 and got.where("position <> v + 1").count() == 0


def test_worst_status(spark):
    df = spark.createDataFrame([("a", "passed"), ("a", "pending"), ("b", "failed"), ("b", "passed"), ("c", "passed")], "k string, s string")
    assert rows(df.groupBy("k").agg(a.worst_status("s").alias("s"))) == [("a", "pending"), ("b", "failed"), ("c", "passed")]


def test_strict_joins_fail_in_the_job(spark):
    many = spark.createDataFrame([(1, "A"), (2, "A")], "k long, tenant string")
    one = lambda data: spark.createDataFrame(data, "k long, tenant string")
    assert j.join_strict(many, one([(1, "A"), (2, "A")]), ["k"], "tenant").count() == 2
    for bad, message in (([(1, "A"), (1, "A"), (2, "A")], "not unique"), ([(1, "A")], "orphan"), ([(1, "A"), (2, "B")], "different tenants")):
        with pytest.raises(Exception, match=message):
            j.join_strict(many, one(bad), ["k"], "tenant").count()


def test_join_tree_rejects_a_view_reached_twice(spark):
    v = spark.createDataFrame([(1,)], "k long")
    edges = [j.Edge("a", "b", ("k",), ("k",)), j.Edge("a", "c", ("k",), ("k",)), j.Edge("b", "c", ("k",), ("k",))]
    with pytest.raises(ValueError, match="reached twice"):
        j.join_tree({"a": v, "b": v, "c": v}, "a", edges, ["c"])


def test_multiset_counts(spark):
    from starloom.operators.metadata import multiset_diff

    x = spark.createDataFrame([("p",), ("p",), ("q",)], "v string")
    y = spark.createDataFrame([("p",), ("r",)], "v string")
    assert rows(multiset_diff(x, y, ["v"])) == [("p", "only_in_design", 1), ("q", "only_in_design", 1), ("r", "only_in_review", 1)]


def test_far_ends_do_not_multiply(spark):
    from starloom.operators.joins import join_as_of

    hist = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2020-01-01 00:00:00', TIMESTAMP_NTZ '9999-12-31 00:00:00', 'x') h(k, valid_from, valid_to, seg)")
    fact = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2021-05-05 00:00:00'), ('a', TIMESTAMP_NTZ '2019-05-05 00:00:00') f(k, t)")
    out = join_as_of(fact, hist, ["k"], "t", F.year)
    assert sorted((str(r.t), r.seg) for r in out.collect()) == [("2019-05-05 00:00:00", None), ("2021-05-05 00:00:00", "x")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1


def test_profile_compares_numbers_as_numbers(spark):
    df = spark.createDataFrame([(9, "9"), (10, "10"), (None, None)], "n long, s string")
    got = {r.column_name: (r.min_text, r.max_text, r.n_nulls) for r in q.profile_columns(df, ["n", "s"]).collect()}
    assert got == {"n": ("9", "10", 1), "s": ("10", "9", 1)}
