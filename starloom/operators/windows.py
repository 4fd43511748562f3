"""Ordered per-key operators that split a hot key.

A plain window puts a whole key into one task. Here every key is cut into
``slices`` of its order column (a month, a day, a number range): rows are
ordered inside (key, slice), and one summary row per slice carries the state
from earlier slices. Only the summaries are ordered per key.

The detail rows are shuffled once; the summaries read the input again, pruned to
the columns they need, so a derived input is best written as a table first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_BEFORE = (W.unboundedPreceding, -1)
_UP_TO = (W.unboundedPreceding, W.currentRow)


def time_slice(ts: Column | str, unit: str = "month") -> Column:
    """Order-preserving slice of a date or timestamp."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc(unit, c.cast("timestamp_ntz"))


def keyed_slice(keys: Sequence[str], slice_: Column) -> Column:
    """(keys, slice) as one struct. The struct is never null, compares null-safe, and
    serves as window partition and as join key, so both use the same shuffle."""
    return F.struct(*keys, slice_.alias("_slice"))


def _over_slices(keys: Sequence[str]):
    return W.partitionBy(*[f"_ks.{k}" for k in keys]).orderBy("_ks._slice")


def _with_carry(local: DataFrame, carried: DataFrame) -> DataFrame:
    return local.join(carried, "_ks", "left")


def previous_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, slice_: Column, out: str) -> DataFrame:
    """Greatest ``value`` over all earlier rows of the key."""
    base = df.withColumn("_v", value).withColumn("_ks", keyed_slice(keys, slice_))
    per_slice = base.groupBy("_ks").agg(F.max("_v").alias("_m"))
    carried = per_slice.select("_ks", F.max("_m").over(_over_slices(keys).rowsBetween(*_BEFORE)).alias("_carry"))
    local = base.withColumn("_local", F.max("_v").over(W.partitionBy("_ks").orderBy(*order).rowsBetween(*_BEFORE)))
    return _with_carry(local, carried).select(*df.columns, F.greatest("_local", "_carry").alias(out))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, slice_: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including this one."""
    base = df.withColumn("_v", value).withColumn("_ks", keyed_slice(keys, slice_))
    per_slice = base.groupBy("_ks").agg(F.sum("_v").alias("_m"))
    carried = per_slice.select("_ks", F.sum("_m").over(_over_slices(keys).rowsBetween(*_BEFORE)).alias("_carry"))
    local = base.withColumn("_local", F.sum("_v").over(W.partitionBy("_ks").orderBy(*order).rowsBetween(*_UP_TO)))
    total = F.coalesce("_carry", F.lit(0)) + F.coalesce("_local", F.lit(0))
    return _with_carry(local, carried).select(*df.columns, total.alias(out))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slice_: Column, out: str) -> DataFrame:
    """Row number per key; ``slice_`` has to rise with the first order column."""
    base = df.withColumn("_ks", keyed_slice(keys, slice_))
    per_slice = base.groupBy("_ks").agg(F.count("*").alias("_m"))
    carried = per_slice.select("_ks", F.sum("_m").over(_over_slices(keys).rowsBetween(*_BEFORE)).alias("_carry"))
    local = base.withColumn("_local", F.row_number().over(W.partitionBy("_ks").orderBy(*order)))
    return _with_carry(local, carried).select(*df.columns, (F.coalesce("_carry", F.lit(0)) + F.col("_local")).alias(out))


def next_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, slice_: Column, out: str) -> DataFrame:
    """``value`` of the following row of the key (null on the last one)."""
    return _neighbour(df, keys, order, value, slice_, out, forward=True)


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, slice_: Column, out: str) -> DataFrame:
    """``value`` of the preceding row of the key (null on the first one)."""
    return _neighbour(df, keys, order, value, slice_, out, forward=False)


def _neighbour(df, keys, order, value, slice_, out, forward):
    pick, shift = (F.min_by, F.lead) if forward else (F.max_by, F.lag)
    boxed = F.struct(F.col(value).alias("v"))
    base = df.withColumn("_ks", keyed_slice(keys, slice_))
    edge = base.groupBy("_ks").agg(pick(boxed, F.struct(*order)).alias("_edge"))
    carried = edge.select("_ks", shift("_edge").over(_over_slices(keys)).alias("_carry"))
    local = base.withColumn("_local", shift(boxed).over(W.partitionBy("_ks").orderBy(*order)))
    found = F.when(F.col("_local").isNotNull(), F.col("_local.v")).otherwise(F.col("_carry.v"))
    return _with_carry(local, carried).select(*df.columns, found.alias(out))


def partition_share(marks: DataFrame, partition: Sequence[str], value: str, out: str) -> DataFrame:
    """Share of the partition total on aggregated marks; null on zero.

    The total is an aggregate joined back, so a partition with very many marks is
    summed map-side instead of gathered into one window.
    """
    from starloom.functions.scalars import ratio
    from starloom.operators.joins import join_lod

    totals = join_lod(marks, partition, [F.sum(value).alias("_total")])
    return totals.withColumn(out, ratio(F.col(value), F.col("_total"))).drop("_total")
