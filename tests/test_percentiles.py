"""Exact percentiles: sketch brackets, far outliers, ties, null groups."""

import random

import pytest
from pyspark.sql import functions as F

from starloom.operators import aggregates as agg
from tests.conftest import rows


def plain(values, percent):
    ordered = sorted(values)
    rank = (len(ordered) - 1) * (percent / 100)
    a, b = ordered[int(rank)], ordered[-(-int(rank * 10**9) // 10**9)] if rank != int(rank) else ordered[int(rank)]
    return a + (b - a) * (rank - int(rank))


@pytest.mark.parametrize("percent", [0, 0.01, 10, 50, 97.3, 100])
def test_equals_sorting(spark, percent):
    rng = random.Random(int(percent * 100))
    held = {"even": [rng.randrange(1000) for _ in range(3000)], "far": [rng.random() for _ in range(500)] + [1e15, -1e15], "one": [4.0], "same": [7.0] * 90, None: [float(x) for x in range(11)]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in held.items() for v in vs] + [("even", None), ("none", None)], "g string, v double")
    got = dict(rows(agg.percentile_exact(df, ["g"], "v", percent, "p", accuracy=100)))
    assert got.keys() == held.keys()
    for g, vs in held.items():
        assert got[g] == pytest.approx(plain(vs, percent), rel=1e-12), g


def test_whole_table_and_exact_types(spark):
    df = spark.range(1001).select((F.col("id") * 3).alias("v"), F.col("id").cast("decimal(12,2)").alias("d"))
    assert rows(agg.percentile_exact(df, [], "v", 25, "p")) == [(750.0,)]
    assert rows(agg.percentile_exact(df, [], "d", 99.95, "p"))[0][0] == pytest.approx(999.5)


def test_an_outlier_leaves_the_bracket_narrow(spark):
    """With one value far away the rows that move on stay few, and the slices of the bracket even."""
    df = spark.range(200_000).select((F.col("id") % 100_000).cast("double").alias("v"), F.lit(1).alias("g")).unionByName(spark.createDataFrame([(1e18, 1), (-1e18, 1)], "v double, g int"))
    lo, hi = agg.rank_bracket(df, ["g"], "v", 50, 4096).select("_lo", "_hi").first()
    inside = df.where(F.col("v").between(lo, hi)).count()
    assert lo <= 50_000 <= hi and inside <= 200_002 * 10 / 4096
    sizes = [r["count"] for r in df.where(F.col("v").between(lo, hi)).groupBy(F.floor((F.col("v") - lo) / ((hi - lo) / 16)).alias("s")).count().collect()]
    assert max(sizes) <= 2 * inside / len(sizes)


def test_two_reads_of_the_input(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"), F.lit("x" * 50).alias("wide")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = agg.percentile_exact(df, ["g"], "v", 50, "p")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "wide" not in text and text.count("FileScan") == 2
    # What is counted inside the bracket serves the slices and the ranks alike: it moves once.
    assert sum("Exchange hashpartitioning(g" in line and " v#" in line and "Reused" not in line for line in text.splitlines()) == 1
