"""Semantic-layer queries compiled to DataFrame plans."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.timeframes import timeframe
from starloom.operators.filters import all_of, predicate
from starloom.operators.joins import Edge, join_tree
from starloom.operators.sets import sort_nulls_first
from starloom.operators import prefix
from starloom.operators.windows import previous_value, running_sum


@dataclass(frozen=True)
class Measure:
    """An aggregate of one field, or a composition of other measures.

    ``filters`` restrict this measure only. ``compose`` receives a lookup that
    turns a measure name into its column.
    """

    aggregate: str | None = None
    field: str | None = None
    filters: Mapping[str, Mapping] = dataclasses.field(default_factory=dict)
    compose: Callable[[Callable[[str], Column]], Column] | None = None


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "average": F.avg, "count_distinct": F.count_distinct,
}


@dataclass(frozen=True)
class Pivot:
    """Turn the values of one asked dimension into columns; all other values, null too, share the column ``rest``.

    ``rest`` must not be one of the values. ``limit`` refuses more columns than that.
    """

    dim: str
    values: Sequence[str]
    rest: str = "other"
    limit: int | None = None


@dataclass(frozen=True)
class Calculation:
    """A column over the sorted result: ``running_sum``, ``previous`` or ``change`` of a measure.

    A long result is not ordered in one task: it is cut into ranges of the sort, or,
    lazily, into the order-preserving slices of the first sort column that ``slice_of`` gives.
    """

    kind: str
    measure: str
    slice_of: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Timed:
    """A timestamp field (UTC, no zone) as a named timeframe of the query's time zone."""

    field: str
    frame: str


TOTAL = "(all)"


@dataclass(frozen=True)
class SemanticModel:
    """Views joined outward from ``base``; fields are named ``view__column``.

    ``access`` maps fields to user attributes. Its predicate is applied to the
    joined rows before anything else and no query setting can remove it.
    """

    base: str
    views: Mapping[str, DataFrame]
    edges: Sequence[Edge] = ()
    dimensions: Mapping[str, Column] = dataclasses.field(default_factory=dict)
    measures: Mapping[str, Measure] = dataclasses.field(default_factory=dict)
    access: Mapping[str, str] = dataclasses.field(default_factory=dict)
    always_where: Mapping[str, Mapping] = dataclasses.field(default_factory=dict)
    default_filters: Mapping[str, Mapping] = dataclasses.field(default_factory=dict)

    def _field(self, name: str) -> Column:
        return self.dimensions.get(name, F.col(name))

    def _aggregate(self, name: str, trail: tuple[str, ...] = ()) -> Column:
        if name in trail:
            raise ValueError(f"cyclic measure {' -> '.join((*trail, name))}")
        measure = self.measures[name]
        if measure.compose is not None:
            if measure.filters:
                raise ValueError("a composed measure takes no filters")
            return measure.compose(lambda other: self._aggregate(other, (*trail, name)))
        value = F.lit(1) if measure.field is None else self._field(measure.field)
        if measure.filters:
            value = F.when(all_of(predicate(self._field(f), s) for f, s in measure.filters.items()), value)
        return AGGREGATES[measure.aggregate](value)

    def _views_of(self, columns: Sequence[Column | str]) -> set[str]:
        text = " ".join(c if isinstance(c, str) else str(c) for c in columns)
        return {v for v in self.views if f"{v}__" in text}

    def rows(self, user: Mapping[str, str] | None, filters: Mapping[str, Mapping], used: Sequence[Column | str] = ()) -> DataFrame:
        """Joined rows under access, fixed, default and asked filters."""
        merged = {**self.default_filters, **filters}
        touched = [*used, *[self._field(f) for f in (*merged, *self.always_where, *self.access)]]
        if self.edges:
            df = join_tree(self.views, self.base, self.edges, sorted(self._views_of(touched) | {self.base}))
        else:
            base = self.views[self.base]
            df = base.select(*[F.col(c).alias(f"{self.base}__{c}") for c in base.columns])
        for name, attribute in self.access.items():
            if user is None or user.get(attribute) is None:
                raise PermissionError(f"user attribute {attribute} is required")
            df = df.where(self._field(name) == F.lit(user[attribute]))
        tests = [predicate(self._field(f), s) for f, s in self.always_where.items()]
        return df.where(all_of([*tests, *[predicate(self._field(f), s) for f, s in merged.items()]]))

    def _dimension(self, dim: str | Timed, time_zone: str | None) -> Column:
        if not isinstance(dim, Timed):
            return self._field(dim)
        if time_zone is None:
            raise ValueError(f"{dim.field} needs a time zone")
        return timeframe(F.convert_timezone(F.lit("UTC"), F.lit(time_zone), self._field(dim.field)), dim.frame)

    def query(
        self, dims: Mapping[str, str | Timed], measures: Mapping[str, str] | None = None, *,
        filters: Mapping[str, Mapping] | None = None, sorts: Sequence[str] | None = None,
        limit: int | None = None, user: Mapping[str, str] | None = None, time_zone: str | None = None,
        pivot: Pivot | None = None, totals: bool = False, fill: str | None = None,
        calculations: Mapping[str, Calculation] | None = None,
    ) -> DataFrame:
        """``{alias: field}`` and ``{alias: measure}``; dimensions alone give their distinct list.

        No dimension gives one row, even over an empty population. ``pivot`` makes a
        column of each value (``value`` or, with several measures, ``value_measure``).
        ``totals`` adds every subtotal, its dimensions shown as ``(all)``. ``fill``
        names a date dimension whose days without rows are shown too, from the first
        to the last day of the population before the asked filters, counts as 0; rows
        without a day stay as they are.
        ``calculations`` are computed on the result, in the order of ``sorts``.
        """
        measures = measures or {}
        chosen = [self._dimension(d, time_zone).alias(alias) for alias, d in dims.items()]
        aggs = [self._aggregate(m).alias(alias) for alias, m in measures.items()]
        rows = self.rows(user, filters or {}, [*chosen, *aggs])
        if pivot and (totals or fill) or (pivot or totals or fill or calculations) and not (dims and measures):
            raise ValueError("pivot, totals, fill and calculations need dimensions and measures, and a pivot stands alone")
        if not measures:
            out = rows.select(*chosen).distinct()
        elif pivot:
            out = self._pivoted(rows, dims, chosen, aggs, pivot)
        elif totals:
            named = rows.withColumns({f"_d{i}": c for i, c in enumerate(chosen)})
            marks = [f"_d{i}" for i in range(len(chosen))]
            cubed = named.cube(*marks).agg(*aggs, *[F.grouping(m).alias(f"_g{m}") for m in marks])
            out = cubed.select(*[F.when(F.col(f"_g{m}") == 1, TOTAL).otherwise(F.col(m).cast("string")).alias(a) for m, a in zip(marks, dims)], *measures)
        elif dims:
            out = rows.groupBy(*chosen).agg(*aggs)
        else:
            out = rows.agg(*aggs)
        if fill:
            out = self._filled(out, dims, measures, fill, user, time_zone)
        for alias, calculation in (calculations or {}).items():
            if not sorts:
                raise ValueError("a calculation needs a sort")
            out = _calculated(out, alias, calculation, sorts)
        if sorts:
            unknown = set(sorts) - set(out.columns)
            if unknown:
                raise ValueError(f"sort on missing output {sorted(unknown)}")
            out = sort_nulls_first(out, sorts)
        if limit is not None:
            if not sorts:
                raise ValueError("a limit needs a sort")
            out = out.limit(limit)
        return out

    def _pivoted(self, rows: DataFrame, dims: Mapping, chosen: Sequence[Column], aggs: Sequence[Column], pivot: Pivot) -> DataFrame:
        if pivot.rest in pivot.values or len(set(pivot.values)) < len(pivot.values):
            raise ValueError(f"the columns of a pivot must differ: {[*pivot.values, pivot.rest]}")
        if pivot.limit is not None and (len(pivot.values) + 1) * len(aggs) > pivot.limit:
            raise ValueError(f"a pivot of {(len(pivot.values) + 1) * len(aggs)} columns; {pivot.limit} are allowed")
        at = list(dims).index(pivot.dim)
        shown = F.when(chosen[at].isin(*pivot.values), chosen[at].cast("string")).otherwise(F.lit(pivot.rest))
        others = [c for k, c in enumerate(chosen) if k != at]
        return rows.withColumn("_pivot", shown).groupBy(*others).pivot("_pivot", [*pivot.values, pivot.rest]).agg(*aggs)

    def _filled(self, out: DataFrame, dims: Mapping, measures: Mapping[str, str], fill: str, user, time_zone: str | None) -> DataFrame:
        if fill not in dims:
            raise ValueError("fill names a dimension of the query")
        day, others = self._dimension(dims[fill], time_zone).cast("date"), [a for a in dims if a != fill]
        # The days shown do not depend on the filters asked for, only on access and fixed ones.
        bounds = self.rows(user, {}, [day]).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
        dated = out.withColumn(fill, F.col(fill).cast("date"))
        # Beside other dimensions every combination that the result has gets all days.
        spread = F.explode(F.sequence(bounds.select("lo").scalar(), bounds.select("hi").scalar()))
        days = dated.select(*others).distinct().select(*others, spread.alias(fill)) if others else bounds.where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias(fill))
        counted = {alias for alias, m in measures.items() if self.measures[m].aggregate in ("count", "count_distinct")}
        spine = days.select(*[F.col(c).alias(f"_s_{c}") for c in dims])
        joined = spine.join(dated, [F.col(f"_s_{c}").eqNullSafe(F.col(c)) for c in dims], "left").select(
            *[F.col(f"_s_{c}").alias(c) for c in dims], *[F.coalesce(a, F.lit(0)).alias(a) if a in counted else F.col(a) for a in measures])
        return joined.unionByName(dated.where(F.col(fill).isNull()).select(*dims, *measures))

    def lineage(self, dims: Mapping[str, str], measures: Mapping[str, str], filters: Mapping[str, Mapping] | None = None) -> dict[str, dict[str, list[str]]]:
        """Physical fields behind each output, and the fields that set its population."""
        names = sorted(f"{v}__{c}" for v, df in self.views.items() for c in df.columns)
        population = {**self.always_where, **self.default_filters, **(filters or {})}
        scope = sorted({n for n in names for f in (*population, *self.access) if _mentions(self._field(f), n)})
        out = {}
        for alias, c in [*((a, self._field(f)) for a, f in dims.items()), *((a, self._aggregate(m)) for a, m in measures.items())]:
            out[alias] = {"fields": [n for n in names if _mentions(c, n)], "population": scope}
        return out


def _calculated(out: DataFrame, alias: str, calculation: Calculation, sorts: Sequence[str]) -> DataFrame:
    whole = out.withColumn("_all", F.lit(1))
    value = calculation.measure
    if calculation.kind not in ("running_sum", "previous", "change"):
        raise ValueError(f"unknown calculation {calculation.kind!r}")
    if calculation.slice_of is None:
        done = prefix.running_sum(whole, ["_all"], sorts, F.col(value), alias) if calculation.kind == "running_sum" else prefix.previous_value(whole, ["_all"], sorts, value, alias)
    else:
        slices = calculation.slice_of(F.col(sorts[0]))
        done = running_sum(whole, ["_all"], sorts, F.col(value), slices, alias) if calculation.kind == "running_sum" else previous_value(whole, ["_all"], sorts, value, slices, alias)
    if calculation.kind == "change":
        done = done.withColumn(alias, F.col(value) - F.col(alias))
    return done.drop("_all")


def _mentions(c: Column, name: str) -> bool:
    import re

    return re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", str(c)) is not None


def select_fields(fields: Sequence[tuple[str, str, Sequence[str], Sequence[str]]], selectors: Sequence[str]) -> list[str]:
    """Ordered include/exclude selectors over (view, field, tags, view_tags).

    ``*`` all, ``view.*`` one view, ``tag:x`` tagged fields, ``view_tag:x``
    fields of tagged views, ``view.field`` one field; a leading ``-`` removes.
    """
    def hit(selector, entry):
        view, name, tags, view_tags = entry
        if selector == "*":
            return True
        if selector.startswith("tag:"):
            return selector[4:] in tags
        if selector.startswith("view_tag:"):
            return selector[9:] in view_tags
        if selector.endswith(".*"):
            return selector[:-2] == view
        return selector == f"{view}.{name}"

    chosen: dict[str, None] = {}
    for selector in selectors:
        drop = selector.startswith("-")
        for entry in fields:
            key = f"{entry[0]}.{entry[1]}"
            if hit(selector.lstrip("-"), entry):
                if drop:
                    chosen.pop(key, None)
                else:
                    chosen.setdefault(key)
    return list(chosen)
