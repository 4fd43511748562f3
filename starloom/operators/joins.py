"""Joins with the cardinality and interval rules of dimensional models.

No hint forces a strategy: the planner broadcasts a side only below
``spark.sql.autoBroadcastJoinThreshold`` and AQE splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from starloom.functions.scalars import surrogate_key
from starloom.operators.windows import keyed_slice


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def fail_when(test: Column, message: str) -> Column:
    """Filter condition that keeps every row and stops the job where ``test`` holds."""
    return F.when(test, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)


def repeats(df: DataFrame, keys: Sequence[str]) -> Column:
    """Whether a key without nulls repeats, as a scalar sub-query over the keys alone."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return df.select(*keys).where(whole).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.count("*") > 0).scalar()


def unique_side(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, failing in the running job when a key repeats.

    The keys alone are counted, map-side first: no value column is aggregated, sorted or
    moved for the check. A key with a null matches nothing in a join, so such rows may repeat.
    """
    return df.where(fail_when(repeats(df, keys), f"not unique on {list(keys)}"))


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that fails when the one-side key repeats."""
    return left.join(unique_side(right, keys), list(keys), "left")


def join_strict(left: DataFrame, right: DataFrame, keys: Sequence[str], tenant: str | None = None) -> DataFrame:
    """Inner join that fails on a repeated one-side key, an orphan, or a match in another tenant."""
    marked = unique_side(right, keys).withColumn("_found", F.lit(True))
    if tenant is not None:
        marked = marked.withColumnRenamed(tenant, "_tenant")
    joined = left.join(marked, list(keys), "left").where(fail_when(F.col("_found").isNull(), "orphan row on the many side"))
    if tenant is not None:
        joined = joined.where(fail_when(F.col(tenant) != F.col("_tenant"), "joined rows of different tenants")).drop("_tenant")
    return joined.drop("_found")


def join_as_of(
    fact: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    at: str,
    slice_of: Callable[[Column], Column] | None = None,
    start: str = "valid_from",
    end: str = "valid_to",
    until: Column | None = None,
) -> DataFrame:
    """Left match of each fact to the interval ``[start, end)`` holding its time.

    Without ``slice_of`` the keys carry the shuffle and the interval is a residual
    predicate: right for short histories. With it (an integer period such as the
    year), an interval is repeated once per period it touches up to ``until``, a
    time no fact passes, and joined on (key, period): one shuffle of the facts, and
    a hot key spreads over its periods. Open and far ends are cut at ``until``, so
    they do not multiply. Without ``until`` it is the facts' latest time, for which
    they are read once more. It is a plain join, so filters on the result still
    reach the fact's scan. The history must not overlap
    (``quality.overlapping_intervals``).
    """
    kept = [c for c in history.columns if c not in keys]
    boxed = history.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.struct(*kept).alias("_h"))
    same_key = [F.col(k) == F.col(f"_h_{k}") for k in keys]
    started, ends = F.col(at) >= F.col(f"_h.{start}"), F.col(f"_h.{end}")
    within = started & (ends.isNull() | (F.col(at) < ends))
    if slice_of is None:
        joined = fact.join(boxed, [*same_key, within], "left")
        return joined.select(*fact.columns, *[F.col("_h")[c].alias(c) for c in kept])
    if until is None:
        until = fact.agg(F.max(at).alias("_until")).scalar()
    reached = boxed.withColumn("_last", F.least(F.coalesce(ends, until), until)).where((F.col(f"_h.{start}") <= F.col("_last")) & (ends.isNull() | (F.col(f"_h.{start}") < ends)))
    spread = reached.withColumn("_hp", F.explode(F.sequence(slice_of(F.col(f"_h.{start}")), slice_of(F.col("_last"))))).drop("_last")
    joined = fact.join(spread, [*same_key, slice_of(F.col(at)) == F.col("_hp"), within], "left")
    return joined.select(*fact.columns, *[F.col("_h")[c].alias(c) for c in kept])


def join_as_of_sliced(
    fact: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    at: str,
    slice_of: Callable[[Column], Column],
    start: str = "valid_from",
    end: str = "valid_to",
) -> DataFrame:
    """The same match when one key is hot on both sides and its intervals are dense.

    Facts and interval starts share one ordered pass per (key, slice of time);
    the latest earlier start is carried over slices as one summary row each, so
    neither a hot key nor its long history meets in one task or multiplies. The
    history must not overlap (``quality.overlapping_intervals``). The fact is
    shuffled once and read a second time for its keys and time only, and filters on
    the result cannot pass the ordering, so it is best given as a written layer
    table that is already filtered.
    """
    kept = [c for c in history.columns if c not in keys]
    interval = F.struct(*kept)
    none = F.lit(None).cast(history.select(interval.alias("i")).schema["i"].dataType)
    facts = fact.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*fact.columns).alias("_fact"), none.alias("_h"))
    no_fact = F.lit(None).cast(facts.schema["_fact"].dataType)
    starts = history.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_kind"), no_fact.alias("_fact"), interval.alias("_h"))
    line = facts.unionByName(starts).withColumn("_ks", keyed_slice(keys, slice_of(F.col("_t"))))
    # Per slice its last start; carried forward, the last start of all earlier slices.
    last = line.where("_kind = 0").groupBy("_ks").agg(F.max_by("_h", "_t").alias("_last"))
    marks = line.select("_ks").distinct().join(last, "_ks", "left")
    earlier = W.partitionBy(*[f"_ks.{k}" for k in keys]).orderBy("_ks._slice").rowsBetween(W.unboundedPreceding, -1)
    carried = marks.select("_ks", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    inside = W.partitionBy("_ks").orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = line.withColumn("_seen", F.last("_h", ignorenulls=True).over(inside)).where("_kind = 1")
    both = seen.join(carried, "_ks", "left").withColumn("_best", F.coalesce("_seen", "_carry"))
    valid = F.col("_best")[end].isNull() | (F.col("_t") < F.col("_best")[end])
    return both.select(*[F.col("_fact")[c].alias(c) for c in fact.columns], *[F.when(valid, F.col("_best")[c]).alias(c) for c in kept])


def with_unknown_member(df: DataFrame, key: str, tenant: str) -> DataFrame:
    """Unmatched rows point at their tenant's unknown member."""
    return df.withColumn(key, F.coalesce(F.col(key), surrogate_key(tenant, F.lit("__UNKNOWN__"))))


def join_roles(fact: DataFrame, dim: DataFrame, dim_key: str, roles: Mapping[str, str]) -> DataFrame:
    """Join one dimension several times, ``{role_prefix: fact_key}``."""
    out = fact
    for role, fact_key in roles.items():
        renamed = dim.select(
            F.col(dim_key).alias(f"_{role}"), *[F.col(c).alias(f"{role}_{c}") for c in dim.columns if c != dim_key]
        )
        out = out.join(renamed, F.col(fact_key) == F.col(f"_{role}"), "left").drop(f"_{role}")
    return out


def join_lod(detail: DataFrame, fixed: Sequence[str], aggregates: Sequence[Column], population: DataFrame | None = None) -> DataFrame:
    """Aggregate at the fixed keys and repeat the result on every detail row."""
    level = (detail if population is None else population).groupBy(*fixed).agg(*aggregates)
    renamed = level.select(*[F.col(k).alias(f"_k_{k}") for k in fixed], *[c for c in level.columns if c not in fixed])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in fixed]
    return detail.join(renamed, on, "left").drop(*[f"_k_{k}" for k in fixed])


@dataclass(frozen=True)
class Edge:
    """One relationship of a join tree."""

    left: str
    right: str
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    join_type: str = "always_left"
    relationship: str = "many_to_one"


# Declared join types and relationship types.
JOIN_TYPES = {
    "left": "left",
    "inner": "inner",
    "full_outer": "full_outer",
    "always_left": "left",
    "always_inner": "inner",
}
RELATIONSHIPS = ("many_to_one", "one_to_many", "one_to_one", "many_to_many", "assumed_many_to_one")


def join_declared(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], join_type: str, relationship: str) -> DataFrame:
    """Join by declared type, checking the unique sides the relationship promises."""
    if relationship not in RELATIONSHIPS:
        raise ValueError(f"unknown relationship {relationship!r}")
    if relationship in ("many_to_one", "one_to_one"):
        right = unique_side(right, [r for _, r in on])
    if relationship in ("one_to_many", "one_to_one"):
        left = unique_side(left, [l for l, _ in on])
    condition = [F.col(f"_left.{l}") == F.col(f"_right.{r}") for l, r in on]
    return left.alias("_left").join(right.alias("_right"), condition, JOIN_TYPES[join_type])


def join_tree(views: Mapping[str, DataFrame], base: str, edges: Sequence[Edge], used: Sequence[str]) -> DataFrame:
    """Join the views a query needs, outward from ``base``.

    Every column is renamed ``view__column``. An edge can be walked from either
    end (a reversed many-to-one becomes one-to-many), no view is reached twice,
    and an ``always_*`` edge is kept even when the query uses no column of it.
    """
    reached: dict[str, tuple[str, Edge, bool] | None] = {base: None}
    frontier = [base]
    while frontier:
        view = frontier.pop(0)
        for edge in edges:
            for here, there, turned in ((edge.left, edge.right, False), (edge.right, edge.left, True)):
                if here != view or (reached.get(view) and reached[view][1] is edge):
                    continue
                if there in reached:
                    raise ValueError(f"view {there} is reached twice")
                reached[there] = (view, edge, turned)
                frontier.append(there)
    missing = set(used) - set(reached)
    if missing:
        raise ValueError(f"no path to {sorted(missing)}")
    needed = {base}
    for view, via in reached.items():
        if view in used or (via and via[1].join_type.startswith("always_")):
            while via:
                needed.add(view)
                view = via[0]
                via = reached[view]
    flipped = {"many_to_one": "one_to_many", "assumed_many_to_one": "one_to_many", "one_to_many": "many_to_one"}
    prefixed = {v: views[v].select(*[F.col(c).alias(f"{v}__{c}") for c in views[v].columns]) for v in needed}
    out = prefixed[base]
    for view, via in reached.items():
        if via is None or view not in needed:
            continue
        parent, edge, turned = via
        lk, rk = (edge.right_keys, edge.left_keys) if turned else (edge.left_keys, edge.right_keys)
        relationship = flipped.get(edge.relationship, edge.relationship) if turned else edge.relationship
        side = prefixed[view]
        if relationship in ("many_to_one", "one_to_one"):
            side = unique_side(side, [f"{view}__{k}" for k in rk])
        if relationship in ("one_to_many", "one_to_one"):
            # The parent's own rows are checked: those joined so far may repeat them through another edge.
            out = out.where(fail_when(repeats(prefixed[parent], [f"{parent}__{k}" for k in lk]), f"{parent} not unique on {list(lk)}"))
        condition = [F.col(f"{parent}__{l}") == F.col(f"{view}__{r}") for l, r in zip(lk, rk)]
        out = out.join(side, condition, JOIN_TYPES[edge.join_type])
    return out


def match_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matches per left row, from one aggregate of the right side (nothing is multiplied out)."""
    counts = right.groupBy(*keys).agg(F.count("*").alias("n_matches"))
    return left.join(counts, list(keys), "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def multiplicity(left: DataFrame, right: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Match-count distribution with an additive measure before and after the join."""
    return (
        match_counts(left, right, keys)
        .groupBy("n_matches")
        .agg(
            F.count("*").alias("left_rows"),
            F.sum(measure).alias("measure_before"),
            F.sum(F.col(measure) * F.col("n_matches")).alias("measure_after"),
        )
    )
