"""Predicates and projections."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.scalars import as_col


def is_value(c: Column | str, value) -> Column:
    """Equality with a scalar, a list of scalars, or null.

    A null cell gives null, which no filter, ``when`` or ``count_if`` lets through;
    so the test stays a plain comparison that reaches the scan.
    """
    c = as_col(c)
    if isinstance(value, (list, tuple, set)):
        test = in_set(c, [v for v in value if v is not None])
        return test | c.isNull() if None in value else test
    return c.isNull() if value is None else c == F.lit(value)


def is_not(c: Column | str, value) -> Column:
    """What ``is_value`` leaves out: a null cell is kept unless null is named."""
    c = as_col(c)
    listed = list(value) if isinstance(value, (list, tuple, set)) else [value]
    named = [v for v in listed if v is not None]
    if len(named) == 1:
        other = c != F.lit(named[0])
    else:
        other = ~c.isin(named) if named else F.lit(True)
    if None in listed:
        return c.isNotNull() & other if named else c.isNotNull()
    return c.isNull() | other if named else other


# Operator names of the numeric and text predicates.
COMPARISONS = {
    "greater_than": lambda c, v: c > v,
    "greater_than_or_equal_to": lambda c, v: c >= v,
    "less_than": lambda c, v: c < v,
    "less_than_or_equal_to": lambda c, v: c <= v,
}
TEXT_TESTS = {
    "contains": lambda c, v: c.contains(v),
    "not_contains": lambda c, v: ~c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
}


def predicate(c: Column | str, spec: Mapping) -> Column:
    """AND of all operators in ``{operator: value}`` on one column."""
    c = as_col(c)
    tests: list[Column] = []
    for name, value in spec.items():
        if name == "is":
            tests.append(is_value(c, value))
        elif name == "not":
            tests.append(is_not(c, value))
        elif name in COMPARISONS:
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"{name} takes a number")
            tests.append(COMPARISONS[name](c, F.lit(value)))
        elif name in TEXT_TESTS:
            tests.append(TEXT_TESTS[name](c, value))
        elif name == "between_dates":
            tests.append(date_range(c, *value))
        else:
            raise ValueError(f"unknown filter operator {name!r}")
    return all_of(tests)


def all_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def date_range(c: Column | str, start: str, end: str, *, inclusive_end: bool = False) -> Column:
    """Half-open ``[start, end)``; a dashboard's "to" date adds one day."""
    lo, hi = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    if inclusive_end:
        hi += dt.timedelta(days=1)
    if lo > hi:
        raise ValueError("reversed date range")
    c = as_col(c)
    return (c >= F.lit(lo)) & (c < F.lit(hi))


def optional(c: Column | str, value, wildcard: str = "ALL") -> Column:
    """No test at all for an unset or wildcard parameter."""
    return F.lit(True) if value is None or value == wildcard else as_col(c) == F.lit(value)


def in_set(c: Column | str, values: Iterable) -> Column:
    """Membership; the empty set keeps no row."""
    values = list(values)
    return as_col(c).isin(values) if values else F.lit(False)


def filter_by(df: DataFrame, filters: Mapping[str, Mapping]) -> DataFrame:
    return df.where(all_of(predicate(c, spec) for c, spec in filters.items()))


def rename_outputs(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select and rename; the mapping has to be one-to-one."""
    if len(set(mapping.values())) != len(mapping):
        raise ValueError("two source columns map to one output")
    missing = set(mapping) - set(df.columns)
    if missing:
        raise ValueError(f"unknown columns {sorted(missing)}")
    return df.select(*[F.col(s).alias(t) for s, t in mapping.items()])


def qualify(df: DataFrame, value: Column, test) -> DataFrame:
    """Filter on the result of a window expression."""
    return df.withColumn("_q", value).where(test(F.col("_q"))).drop("_q")
