"""Filter-context measures: one report, measures evaluated in changed contexts.

Measures that keep the report's grouping share one aggregate with a condition
per measure, so a report scans its rows once per distinct grouping instead of
once per measure and visible group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.filters import all_of, predicate
from starloom.operators.joins import join_lod


@dataclass(frozen=True)
class Change:
    """One context change: ``replace``, ``intersect`` or ``remove`` the filter of a field."""

    kind: str
    field: str
    spec: Mapping | None = None


@dataclass(frozen=True)
class ContextMeasure:
    value: str
    changes: tuple[Change, ...] = ()
    aggregate: Callable[[Column], Column] = F.sum


def _resolve(dims: Sequence[str], context: Mapping[str, Mapping], changes: Sequence[Change], locked: Sequence[str]):
    filters: dict[str, list[Mapping]] = {f: [s] for f, s in context.items()}
    grouping = list(dims)
    for change in changes:
        if change.field in locked:
            raise PermissionError(f"{change.field} sets the population and cannot be changed by a measure")
        if change.kind == "intersect":
            filters.setdefault(change.field, []).append(change.spec)
            continue
        filters.pop(change.field, None)
        if change.kind == "replace":
            filters[change.field] = [change.spec]
        elif change.kind != "remove":
            raise ValueError(f"unknown context change {change.kind!r}")
        grouping = [g for g in grouping if g != change.field]
    test = all_of(predicate(f, s) for f, specs in filters.items() for s in specs)
    return tuple(grouping), test


def context_report(
    df: DataFrame, dims: Sequence[str], context: Mapping[str, Mapping], measures: Mapping[str, ContextMeasure],
    *, locked: Sequence[str] = (), zeros: bool = False,
) -> DataFrame:
    """Rows are the groups visible under ``context``; each measure has its own context.

    A measure whose change drops a grouping field is aggregated without it and
    joined to the visible groups; it never adds rows. Without dimensions there is
    exactly one row. ``zeros`` turns empty sums into 0 instead of null.
    """
    visible = all_of(predicate(f, s) for f, s in context.items())
    plans: dict[tuple[str, ...], dict[str, Column]] = {tuple(dims): {}}
    needed: dict[tuple[str, ...], Column] = {tuple(dims): visible}
    for name, m in measures.items():
        grouping, test = _resolve(dims, context, m.changes, locked)
        plans.setdefault(grouping, {})[name] = m.aggregate(F.when(test, F.col(m.value)))
        needed[grouping] = needed[grouping] | test if grouping in needed else test
    out = None
    for grouping, aggs in plans.items():
        rows = df.where(needed[grouping])
        columns = [c.alias(n) for n, c in aggs.items()]
        if out is None:
            level = rows.groupBy(*grouping).agg(F.count_if(visible).alias("_visible"), *columns)
            out = (level.where("_visible > 0") if dims else level).drop("_visible")
            continue
        level = rows.groupBy(*grouping).agg(*columns)
        if grouping:
            renamed = level.select(*[F.col(g).alias(f"_g_{g}") for g in grouping], *aggs)
            on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in grouping]
            out = out.join(renamed, on, "left").drop(*[f"_g_{g}" for g in grouping])
        else:
            # One row: read as scalar subqueries, so the visible groups are not moved.
            out = out.withColumns({n: level.select(n).scalar() for n in aggs})
    out = out.select(*dims, *measures)
    return out.fillna(0, list(measures)) if zeros else out


def fixed_lod_report(
    df: DataFrame, population: Mapping[str, Mapping], dimension_filters: Mapping[str, Mapping],
    fixed: Sequence[str], fixed_value: Column, dims: Sequence[str], aggs: Sequence[Column],
) -> DataFrame:
    """Population and date filters first, then the fixed level, then dimension filters, then marks."""
    kept = df.where(all_of(predicate(f, s) for f, s in population.items()))
    level = join_lod(kept, fixed, [fixed_value], population=kept)
    shown = level.where(all_of(predicate(f, s) for f, s in dimension_filters.items()))
    return shown.groupBy(*dims).agg(*aggs)


def selected_value(selection: Sequence, default):
    """The one selected parameter value, or the default when none or several are selected."""
    return selection[0] if len(selection) == 1 else default


def what_if(df: DataFrame, measure: str, factor, out: str) -> DataFrame:
    """Scalar factor applied after aggregation; blank stays blank."""
    return df.withColumn(out, F.col(measure) * F.lit(factor))


def secure(df: DataFrame, role: str, permissions: Mapping[str, Mapping[str, Mapping]]) -> DataFrame:
    """Row filter of a role; an unknown role sees an error, never unfiltered rows."""
    if role not in permissions:
        raise PermissionError(f"no row policy for role {role!r}")
    return df.where(all_of(predicate(f, s) for f, s in permissions[role].items()))


def topic_population(topics: DataFrame) -> DataFrame:
    """Role of each topic on its base and whether it has the main topic's population.

    Input columns: base_view, topic, ancestors array, always_where text,
    always_fields array, default_fields array.
    """
    main = topics.where(F.size("ancestors") == 0).groupBy("base_view").agg(
        F.min_by(F.struct("topic", "always_where", "always_fields", "default_fields"), "topic").alias("_m"))
    joined = topics.join(main, "base_view")
    role = (
        F.when(F.col("topic") == F.col("_m.topic"), "main")
        .when(F.array_contains("ancestors", F.col("_m.topic")), "variant").otherwise("unlinked")
    )
    promoted = F.array_except(F.array_intersect("_m.default_fields", "always_fields"), F.col("_m.always_fields"))
    return joined.select(
        "base_view", "topic", role.alias("role"),
        (F.sha2(F.coalesce("always_where", F.lit("")), 256) == F.sha2(F.coalesce("_m.always_where", F.lit("")), 256)).alias("same_population"),
        F.array_join(F.array_sort(promoted), ",").alias("promoted_defaults"),
    )
