"""Change-log operators: current state, conflicts, replays, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from starloom.functions.scalars import surrogate_key
from starloom.operators import prefix
from starloom.operators.windows import next_value, time_slice


def latest_version(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order_by`` per key.

    Rank one is kept before the shuffle as well as after it (the planner puts a
    window group limit under the exchange), so a key with a third of the log
    ships one candidate row per map task. Remaining columns break ties, which
    keeps the result the same on every run.
    """
    ties = [c for c in df.columns if c not in (*keys, *order_by)]
    newest = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in (*order_by, *ties)])
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def current_state(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], is_deleted: Column) -> DataFrame:
    """Latest version per key, tombstones dropped only after the choice."""
    return latest_version(df, keys, order_by).where(~is_deleted)


def version_conflicts(df: DataFrame, keys: Sequence[str], sequence: str, payload: Sequence[str]) -> DataFrame:
    """Same key and sequence with different payloads (arrival columns left out)."""
    distinct = df.select(*keys, sequence, *payload).distinct()
    return (
        distinct.groupBy(*keys, sequence)
        .agg(F.count("*").alias("n_payloads"))
        .where("n_payloads > 1")
    )


def identity_conflicts(df: DataFrame, event_id: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One source event id that carries two payloads."""
    distinct = df.select(*event_id, *payload).distinct()
    return distinct.groupBy(*event_id).agg(F.count("*").alias("n_payloads")).where("n_payloads > 1")


def replay_count(df: DataFrame, version: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Versions delivered again, in total or per ``by`` column."""
    per_version = df.groupBy(*version).agg(F.count("*").alias("_n"))
    return per_version.groupBy(*by).agg(
        F.sum("_n").alias("deliveries"), F.sum(F.col("_n") - 1).alias("replays")
    )


def apply_batch(state: DataFrame, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Fold a batch into a state that still holds tombstones.

    The greatest sequence wins whatever the arrival order, so folding batches in
    any order equals a full rebuild. Tombstones stay until they are read away
    with ``current_state``'s filter, or a late older row would come back.
    """
    return latest_version(state.unionByName(batch.select(*state.columns)), keys, order_by)


def normalize_history(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Typed history with exact replays collapsed."""
    typed = df.select(*[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])
    return typed.distinct()


def history_from_versions(df: DataFrame, keys: Sequence[str], at: str, unit: str | None = None) -> DataFrame:
    """Half-open intervals from versions: each ends where the next one starts.

    Without ``unit`` by ranges of the rows (``prefix``); with it, lazily, by slices of time.
    """
    if unit is None:
        return prefix.next_value(df.withColumnRenamed(at, "valid_from"), keys, ["valid_from"], "valid_from", "valid_to")
    out = next_value(df.withColumnRenamed(at, "valid_from"), keys, ["valid_from"], "valid_from",
                     time_slice("valid_from", unit), "valid_to")
    return out


def history_key(df: DataFrame, natural: Sequence[str], start: str, out: str, fmt: str) -> DataFrame:
    return df.withColumn(out, surrogate_key(*natural, F.date_format(start, fmt)))


def with_unknown_rows(dim: DataFrame, tenants: DataFrame, tenant: str, key: str, label: str) -> DataFrame:
    """Dimension plus one unknown row per tenant."""
    unknown = tenants.select(tenant).distinct()
    filler = {
        key: surrogate_key(tenant, F.lit("__UNKNOWN__")),
        tenant: F.col(tenant),
        label: F.lit("Unknown"),
    }
    return dim.unionByName(
        unknown.select(*[filler.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in dim.schema])
    )


def apply_counterfactual(df: DataFrame, keys: Sequence[str], *, replace: DataFrame | None = None, append: DataFrame | None = None) -> DataFrame:
    """A what-if copy of a table: rows replaced by key, rows appended."""
    out = df
    if replace is not None:
        out = out.join(replace.select(*keys), list(keys), "left_anti").select(*df.columns).unionByName(replace.select(*df.columns))
    if append is not None:
        out = out.unionByName(append.select(*df.columns))
    return out
