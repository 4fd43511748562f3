"""Prefix scans over ranges: ordered per-key operators without a slice from the caller.

The rows are dealt out by ranges of (keys, order) and written once. A range holds many
small keys or a part of a busy one, by sampled quantiles, so no task holds a key that is
larger than its share. Inside a range a plain window does the work. Only a key that
reaches over the edge of a range carries something on: one row per range and edge, folded
by an associative rule in the order of the ranges, and broadcast, as its number is twice
the ranges' at most.

The input is read once and moves twice: by ranges, and to the windows. Ranges come from the
first move, so they are written; a reader of the result reads that table. Rows equal in
keys and order stay in one range. Null keys are a key like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from starloom.session import scratch_path

_BEFORE = (W.unboundedPreceding, -1)


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows as a written table with ``_part``, the number of their range; ranges rise with (keys, order)."""
    path = scratch_path(df.sparkSession, "ranges")
    dealt = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def _with_carry(table: DataFrame, keys: Sequence[str], summary: Column, carry, local: Column, out: str, found) -> DataFrame:
    """``local`` over each (range, key), joined by ``found`` with what ``carry`` makes of the key's summaries in other ranges."""
    at = F.struct("_part", *keys)
    key = F.struct(*keys)
    ends = table.groupBy("_part").agg(F.min(key).alias("_a"), F.max(key).alias("_b"))
    edges = ends.select("_part", F.explode(F.array("_a", "_b")).alias("_k")).distinct()
    edges = F.broadcast(edges.select(F.struct("_part", *[F.col(f"_k.{k}").alias(k) for k in keys]).alias("_at")))  # two per range
    runs = table.withColumn("_here", at).join(edges, F.col("_here") == F.col("_at"), "left_semi").groupBy("_here").agg(summary.alias("_m"))
    per_key = W.partitionBy(*[f"_here.{k}" for k in keys]).orderBy("_here._part")
    carried = F.broadcast(runs.select(F.col("_here").alias("_at"), carry(per_key).alias("_carry")))
    done = table.withColumn("_here", at).withColumn("_local", local).join(carried, F.col("_here") == F.col("_at"), "left")
    kept = [c for c in table.columns if c != "_part"]
    return done.select(*kept, found.alias(out))


def _inside(order: Sequence[str]):
    return W.partitionBy("_here").orderBy(*order)


def previous_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Greatest ``value`` over all earlier rows of the key."""
    table = ranged(df.withColumn("_v", value), keys, order)
    return _with_carry(
        table, keys, F.max("_v"), lambda w: F.max("_m").over(w.rowsBetween(*_BEFORE)), F.max("_v").over(_inside(order).rowsBetween(*_BEFORE)), out,
        F.greatest("_local", "_carry")).drop("_v")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including this one."""
    table = ranged(df.withColumn("_v", value), keys, order)
    total = F.coalesce("_carry", F.lit(0)) + F.coalesce("_local", F.lit(0))
    return _with_carry(
        table, keys, F.sum("_v"), lambda w: F.sum("_m").over(w.rowsBetween(*_BEFORE)),
        F.sum("_v").over(_inside(order).rowsBetween(W.unboundedPreceding, W.currentRow)), out, total).drop("_v")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Row number per key."""
    table = ranged(df, keys, order)
    return _with_carry(
        table, keys, F.count("*"), lambda w: F.sum("_m").over(w.rowsBetween(*_BEFORE)), F.row_number().over(_inside(order)), out,
        F.coalesce("_carry", F.lit(0)) + F.col("_local"))


def next_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``value`` of the following row of the key (null on the last one)."""
    return _neighbour(df, keys, order, value, out, F.min_by, F.lead)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """``value`` of the preceding row of the key (null on the first one)."""
    return _neighbour(df, keys, order, value, out, F.max_by, F.lag)


def _neighbour(df, keys, order, value, out, pick, shift):
    boxed = F.struct(F.col(value).alias("v"))
    found = F.when(F.col("_local").isNotNull(), F.col("_local.v")).otherwise(F.col("_carry.v"))
    return _with_carry(ranged(df, keys, order), keys, pick(boxed, F.struct(*order)), lambda w: shift("_m").over(w), shift(boxed).over(_inside(order)), out, found)
