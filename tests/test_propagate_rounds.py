"""What a round of propagation or of the component search sends to the driver."""

from pyspark.sql import functions as F
from tests.conftest import rows

from starloom.operators import lineage


def test_no_round_broadcasts_what_grows_with_the_graph(spark, monkeypatch):
    plans, cut = [], lineage.cut_lineage

    def seen(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(lineage, "cut_lineage", seen)
    n = 2**13 + 100  # nodes of a level; every level changes one round after the one before
    nodes = spark.range(4 * n).select(F.col("id").alias("node_id"), F.when(F.col("id") < n, 5).otherwise(F.col("id") % 3).cast("int").alias("level"), F.lit(0).alias("flags"))
    edges = spark.range(3 * n).select(F.col("id").alias("source_id"), (F.col("id") + n).alias("target_id"))
    done = lineage.propagate(nodes, edges, {"level": "max", "flags": "bit_or"})
    assert done.count() == done.where("level = 5 AND flags = 0").count() == 4 * n
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in plans)


def test_no_round_of_components_broadcasts(spark, monkeypatch):
    plans, cut = [], lineage.cut_lineage

    def seen(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(lineage, "cut_lineage", seen)
    edges = spark.createDataFrame([(5, 1), (5, 2), (7, 5), (9, 8), (4, 4), (None, 3)], "source_id long, target_id long")
    done = lineage.components(edges)
    assert {tuple(r) for r in done.collect()} == {(1, 1), (2, 1), (5, 1), (7, 1), (8, 8), (9, 8), (4, 4)}
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)


def test_nulls_and_strangers_say_nothing(spark):
    nodes = spark.createDataFrame([(1, 3, 1), (2, None, None), (3, 1, 4), (None, 9, 8)], "node_id long, level int, flags int")
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, None), (None, 1), (7, 1), (3, 8)], "source_id long, target_id long")
    done = lineage.propagate(nodes, edges, {"level": "max", "flags": "bit_or"})
    assert rows(done) == rows(spark.createDataFrame([(1, 3, 1), (2, 3, 1), (3, 3, 5), (None, 9, 8)], "a long, b int, c int"))
