"""Sorting, set operations and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.scalars import row_hash
from starloom.operators import prefix
from starloom.operators.windows import row_numbers


def sort_nulls_first(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in cols])


def limit_report(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows, as the report asks."""
    if n < 1:
        raise ValueError("a report limit has to be positive")
    return df.limit(n)


def topk(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of a total order, marked as an incomplete population."""
    if not order:
        raise ValueError("a limit needs a sort")
    return df.orderBy(*order).limit(k).withColumn("is_complete", F.lit(False))


def union_checks(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def key_difference(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, labelled missing_key or extra_key.

    One aggregate over the tagged union: a single shuffle on the keys, and key
    copies collapse on the map side.
    """
    tagged = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_a")).unionByName(
        actual.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_a"))
    )
    sides = tagged.groupBy(*keys).agg(F.max("_e").alias("_e"), F.max("_a").alias("_a"))
    return sides.where(F.col("_e") != F.col("_a")).select(
        *keys, F.when(F.col("_e") == 1, "missing_key").otherwise("extra_key").alias("kind")
    )


def key_intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def duplicate_deliveries(df: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Redundant deliveries: rows beyond the first of each distinct payload.

    The payload is grouped before the global sum, so copies combine map-side.
    """
    per_payload = df.groupBy(*payload).agg(F.count("*").alias("_n"))
    return per_payload.agg(
        F.sum("_n").alias("deliveries"), F.count("*").alias("distinct_payloads"),
        F.sum(F.col("_n") - 1).alias("redundant"),
    )


def merge_no_conflict(extracts: Sequence[DataFrame], key: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Union extracts by identity; equal content merges, unequal content is a conflict."""
    both = union_checks([e.select(*key, *payload) for e in extracts])
    versions = both.withColumn("_h", row_hash(*payload)).groupBy(*key, "_h").agg(F.count("*").alias("_n"))
    return versions.groupBy(*key).agg(
        F.sum("_n").alias("n_records"), F.count("*").alias("n_versions")
    ).withColumn("status", F.when(F.col("n_versions") > 1, "conflict").otherwise("merged"))


def with_position(df: DataFrame, order: Sequence[Column | str], slice_: Column | None = None, out: str = "position") -> DataFrame:
    """Global 1-based position, ranked range by range (or by the given slice) rather than in one task."""
    if slice_ is None:
        return prefix.row_numbers(df.withColumn("_all", F.lit(1)), ["_all"], order, out).drop("_all")
    return row_numbers(df.withColumn("_all", F.lit(1)), ["_all"], order, slice_, out).drop("_all")


def order_mismatches(expected: DataFrame, actual: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """Rows present on both sides at different positions."""
    a = actual.select(*keys, F.col(position).alias("actual_position"))
    return (
        expected.select(*keys, F.col(position).alias("expected_position"))
        .join(a, list(keys))
        .where(F.col("expected_position") != F.col("actual_position"))
    )
