"""Aggregates beyond plain ``groupBy().agg()``.

All of them pre-aggregate on the map side first, so a group holding a large
share of the rows reaches its reducer as a few partial rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from starloom.operators.joins import fail_when


def sum_where(test: Column, value: Column | str) -> Column:
    """Measure-level filter: the row population of other measures is unchanged."""
    return F.sum(F.when(test, F.col(value) if isinstance(value, str) else value))


def flag_any(test: Column) -> Column:
    return F.max(F.when(test, 1).otherwise(0))


def listed_values(df: DataFrame, groups: Sequence[str], value: str, position: str = "position") -> DataFrame:
    """Sorted distinct values per group as rows (groups, position, value).

    A list of any length stays in rows: no cell gathers a group, and rows shrink to
    distinct pairs before they are numbered.
    """
    distinct = df.where(F.col(value).isNotNull()).select(*groups, value).distinct()
    return distinct.withColumn(position, F.row_number().over(W.partitionBy(*groups).orderBy(value)))


def rank_bracket(df: DataFrame, groups: Sequence[str], value: str, percent: float, accuracy: int) -> DataFrame:
    """Per group its rows and two values that enclose the ranks of the percentile.

    A quantile sketch, merged from all tasks, is off by at most one part in ``accuracy``
    of the rows; the values are taken three such parts to either side. A group of no more
    than ``accuracy`` rows is enclosed whole.
    """
    reach, at = 3.0 / accuracy, percent / 100.0
    ends = F.percentile_approx(F.col(value).cast("double"), [max(0.0, at - reach), min(1.0, at + reach)], accuracy)
    found = df.groupBy(*groups).agg(F.count("*").alias("_total"), ends.alias("_ends"), F.min(F.col(value).cast("double")).alias("_min"), F.max(F.col(value).cast("double")).alias("_max"))
    small = F.col("_total") <= accuracy
    low = F.col("_min") if at <= reach else F.when(small, F.col("_min")).otherwise(F.col("_ends")[0])
    high = F.col("_max") if at >= 1 - reach else F.when(small, F.col("_max")).otherwise(F.col("_ends")[1])
    return found.select(*groups, "_total", low.alias("_lo"), high.alias("_hi"))


def percentile_exact(df: DataFrame, groups: Sequence[str], value: str, percent: float, out: str, buckets: int = 256, accuracy: int = 4096) -> DataFrame:
    """Exact interpolated percentile (0-100) that never holds one group in one task.

    The first read sketches each group and gives two values that enclose the wanted ranks,
    few parts in ``accuracy`` of the rows apart, however the values lie (a far outlier is
    outside). The second read counts what is below, which one number per task and group
    does, and counts the values inside; only they move. They are cut into ``buckets``
    slices, and only the slices that hold the ranks are ordered. Ranks come from exact
    counts; a rank outside its bracket, which the sketch's bound excludes, stops the job.
    """
    if not groups:
        whole = percentile_exact(df.withColumn("_all", F.lit(1)), ["_all"], value, percent, out, buckets, accuracy)
        return whole.drop("_all")
    groups, at = list(groups), F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(*groups, value)
    bracket = rank_bracket(rows, groups, value, percent, accuracy).select(*[F.col(g).alias(f"_g_{g}") for g in groups], "_total", "_lo", "_hi")
    near = rows.join(bracket, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]).where(at <= F.col("_hi"))
    # All values below the bracket are one key, so their number is folded before it moves.
    held = near.select(*groups, F.when(at >= F.col("_lo"), F.col(value)).alias(value), "_total", "_lo", "_hi")
    counts = held.groupBy(*groups, value, "_total", "_lo", "_hi").agg(F.count("*").alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / buckets
    share = (at - F.col("_lo")) / F.nullif(width, F.lit(0.0))
    sliced = counts.withColumn("_slice", F.when(F.col(value).isNull(), -1).otherwise(F.coalesce(F.floor(share), F.lit(0))))
    rank = (F.col("_total") - 1) * (percent / 100.0)
    by_slice = W.partitionBy(*groups).orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    slices = (
        sliced.groupBy(*groups, "_slice", "_total")
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_before", F.sum("_m").over(by_slice) - F.col("_m"))
        .where((F.col("_before") <= F.ceil(rank)) & (F.col("_before") + F.col("_m") > F.floor(rank)))
        .select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_slice").alias("_s"), "_before")
    )
    inside = W.partitionBy(*groups, "_slice").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    ranked = sliced.join(slices, [*same, F.col("_slice") == F.col("_s")]).withColumn("_first", F.col("_before") + F.sum("_n").over(inside) - F.col("_n"))
    last = F.col("_first") + F.col("_n") - 1
    low = F.when((F.col("_first") <= F.floor(rank)) & (last >= F.floor(rank)), at)
    high = F.when((F.col("_first") <= F.ceil(rank)) & (last >= F.ceil(rank)), at)
    edges = ranked.groupBy(*groups).agg(F.max(low).alias("_a"), F.max(high).alias("_b"), F.max(rank - F.floor(rank)).alias("_f"))
    sound = edges.where(fail_when(F.col("_a").isNull() | F.col("_b").isNull(), "a rank lies outside its bracket"))
    return sound.select(*groups, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(out))


def once_per_key(df: DataFrame, groups: Sequence[str], key: str, value: str) -> DataFrame:
    """Undo fan-out: one value per (group, key); a key with two values is marked, not guessed."""
    return df.groupBy(*groups, key).agg(
        F.min(value).alias(value), (F.min(value) != F.max(value)).alias("is_ambiguous")
    )


def distinct_on(df: DataFrame, groups: Sequence[str], key: str, value: str, how: str, out: str, percent: float = 50.0) -> DataFrame:
    """sum / average / median / percentile over one value per key.

    A key with two values stops the job: which of them is right is not ours to guess.
    """
    single = once_per_key(df, groups, key, value).where(fail_when(F.col("is_ambiguous"), f"{value} differs within one {key}"))
    if how in ("median", "percentile"):
        return percentile_exact(single, groups, value, 50.0 if how == "median" else percent, out)
    fn = {"sum": F.sum, "average": F.avg}[how]
    return single.groupBy(*groups).agg(fn(value).alias(out))


# Statuses from best to worst.
STATUS_ORDER = ("passed", "pending", "failed")


def worst_status(status: Column | str) -> Column:
    """Aggregate in which the worst status of the group wins."""
    order = F.array(*[F.lit(s) for s in STATUS_ORDER])
    position = F.array_position(order, F.col(status) if isinstance(status, str) else status)
    return F.element_at(order, F.max(position).cast("int"))


def additivity_strategy(measures: DataFrame) -> DataFrame:
    """Which measures may be pre-aggregated, from (aggregation, additivity)."""
    summable = F.col("aggregation").isin("sum", "count") & (F.col("additivity") == "additive")
    return measures.withColumn("strategy", F.when(summable, "pre_aggregate").otherwise("keep_detail"))
