"""Data contracts. Every check returns the violating rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.scalars import as_col

from starloom.operators import prefix
from starloom.operators.windows import previous_max, running_sum

FAR = "9999-12-31 00:00:00"  # stands for an open interval end in comparisons


def grain(df: DataFrame, keys: Sequence[str], issue: str) -> DataFrame:
    """Keys that repeat or hold a null, with the key as text so checks can be stacked."""
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys])
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n_rows"))
        .where((F.col("n_rows") != 1) | any_null)
        .select(F.lit(issue).alias("issue"), text.alias("entity"), "n_rows")
    )


def required_values(df: DataFrame, entity: Column, rules: Mapping[str, Column]) -> DataFrame:
    """One row per (entity, broken rule), in a single pass."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(n)) for n, test in rules.items()]))
    return df.select(entity.cast("string").alias("entity"), F.explode(found).alias("issue"))


def blank_or_unsafe(c: Column | str, separator: str = "|") -> Column:
    c = as_col(c)
    return c.isNull() | (c == "") | c.contains(separator)


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return child.join(parent, list(keys), "left_anti")


def invalid_intervals(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(F.col(start) >= F.col(end))


def overlapping_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, slice_: Column | None = None) -> DataFrame:
    """Distinct history rows that start before an earlier row of their key has ended.

    One row per offending interval instead of every pair, so a key with many
    overlapping rows costs a sort, not a square. Ends are compared in their own
    type, so intervals that meet within a day are told apart. Without ``slice_`` rows
    are ordered by ranges (``prefix``); with it, lazily, by slices of the start.
    """
    rows = df.distinct()
    rest = [c for c in rows.columns if c not in (*keys, start, end)]
    end_or_far = F.coalesce(F.col(end), F.lit(FAR).cast("timestamp_ntz").cast(df.schema[end].dataType))
    closed, order = rows.withColumn("_end", end_or_far), [start, "_end", *rest]
    if slice_ is None:
        seen = prefix.previous_max(closed, keys, order, F.col("_end"), "covered_until")
    else:
        seen = previous_max(closed, keys, order, F.col("_end"), slice_, "covered_until")
    return seen.where(F.col(start) < F.col("covered_until")).drop("_end")


def match_count_violations(
    left: DataFrame, history: DataFrame, keys: Sequence[str], row_key: Sequence[str], at: str, slice_of: Callable[[Column], Column] | None = None,
    start: str = "valid_from", end: str = "valid_to",
) -> DataFrame:
    """Rows whose time falls into no interval, or into several, of their key.

    The number of open intervals at a time is starts so far minus ends so far, a
    running sum per key: rows and intervals are never paired. Without ``slice_of`` the
    line is ordered by ranges (``prefix``).
    """
    blank = F.struct(*[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in row_key])
    rows = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(0).alias("_step"), F.struct(*row_key).alias("_row"))
    open_ = history.where(F.col(end).isNull() | (F.col(start) < F.col(end)))
    edge = lambda c, step: open_.where(F.col(c).isNotNull()).select(*keys, F.col(c).alias("_t"), F.lit(0).alias("_kind"), F.lit(step).alias("_step"), blank.alias("_row"))
    line = rows.unionByName(edge(start, 1)).unionByName(edge(end, -1))
    if slice_of is None:
        counted = prefix.running_sum(line, keys, ["_t", "_kind"], F.col("_step"), "n_matches")
    else:
        counted = running_sum(line, keys, ["_t", "_kind"], F.col("_step"), slice_of(F.col("_t")), "n_matches")
    return counted.where("_kind = 1 AND n_matches <> 1").select("_row.*", "n_matches")


def sum_mismatch(parent: DataFrame, child: DataFrame, keys: Sequence[str], field: str, child_value: str) -> DataFrame:
    """Parents whose stored total differs from the sum of their children."""
    totals = child.groupBy(*keys).agg(F.sum(child_value).alias("child_total"))
    joined = parent.join(totals, list(keys), "left").withColumn("child_total", F.coalesce("child_total", F.lit(0)))
    return joined.where(F.col(field) != F.col("child_total")).select(*keys, field, "child_total")


def broken_identity(df: DataFrame, row_key: Sequence[str], identities: Mapping[str, Column]) -> DataFrame:
    """Rows for which a named arithmetic identity does not hold."""
    failing = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in identities.items()]))
    return df.select(*row_key, F.explode(failing).alias("identity"))


def coverage_drift(source: DataFrame, fact: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Rows missing on either side, and shared rows with a changed value."""
    s = source.select(*keys, F.struct(*compared).alias("_s"))
    f = fact.select(*keys, F.struct(*compared).alias("_f"))
    joined = s.join(f, list(keys), "full_outer")
    issue = (
        F.when(F.col("_f").isNull(), "missing_in_fact")
        .when(F.col("_s").isNull(), "missing_in_source")
        .when(~F.col("_s").eqNullSafe(F.col("_f")), "value_drift")
    )
    return joined.select(*keys, issue.alias("issue")).where("issue is not null")


def parent_mismatch(child: DataFrame, parent: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Child rows whose ``column`` (currency, tenant, …) differs from the parent's."""
    p = parent.select(*keys, F.col(column).alias(f"parent_{column}"))
    return child.join(p, list(keys)).where(F.col(column) != F.col(f"parent_{column}"))


def type_violations(df: DataFrame, entity: Column, rules: Mapping[str, Column]) -> DataFrame:
    """Values that do not fit their declared type; rules are true when the value fits."""
    return required_values(df, entity, {n: ~F.coalesce(ok, F.lit(False)) for n, ok in rules.items()})


def fits_long(c: Column | str) -> Column:
    return as_col(c).rlike("^-?[0-9]+$") & as_col(c).try_cast("long").isNotNull()


def fits_boolean(c: Column | str) -> Column:
    return as_col(c).isin("true", "false")


def fits_iso_date(c: Column | str) -> Column:
    parsed = F.try_to_date(as_col(c), "yyyy-MM-dd")
    return F.date_format(parsed, "yyyy-MM-dd") == as_col(c)


def fits_identifier(c: Column | str) -> Column:
    return as_col(c).rlike("^[A-Za-z0-9]+$")


def column_tests(df: DataFrame, not_null: Sequence[str], unique: Sequence[str]) -> DataFrame:
    """Failure counts of declared not_null and unique column tests, as rows."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
    stacked = ", ".join(f"'{c}', `{c}`" for c in not_null)
    out = nulls.selectExpr(f"stack({len(not_null)}, {stacked}) AS (column_name, failures)").withColumn("test", F.lit("not_null"))
    for c in unique:
        repeats = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")).where("_n > 1")
        out = out.unionByName(
            repeats.agg(F.count("*").alias("failures")).select(F.lit(c).alias("column_name"), "failures", F.lit("unique").alias("test"))
        )
    return out.select("column_name", "test", "failures")


def unknown_values(df: DataFrame, column: str, domain: DataFrame, domain_column: str) -> DataFrame:
    """Values outside the domain with their row counts; values are grouped before the anti join."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
    known = domain.select(F.col(domain_column).alias("value")).distinct()
    return counts.join(known, "value", "left_anti")


def normalization_collisions(df: DataFrame, raw: str, normalized: Column) -> DataFrame:
    """Different raw keys that become one key after normalisation."""
    pairs = df.select(normalized.alias("normalized"), F.col(raw).alias("_raw")).distinct()
    return pairs.groupBy("normalized").agg(F.count("_raw").alias("n_spellings")).where("n_spellings > 1")


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls, blanks, distinct values, minimum and maximum per column.

    Each row becomes (column, text, number) cells, grouped by cell before the
    per-column aggregate, so exact distinct counts never gather raw rows of a
    column. Numbers are compared as numbers, all else as text.
    """
    number = lambda c: F.col(c).cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(None).cast("double")
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"), number(c).alias("x")) for c in columns
    ])).alias("_c")).select("_c.*")
    counted = cells.groupBy("column_name", "v", "x").agg(F.count("*").alias("_n"))
    present = F.col("v").isNotNull()
    sized = F.when(present, F.struct("x", "v"))
    return counted.groupBy("column_name").agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~present, F.col("_n"))), F.lit(0)).alias("n_nulls"),
        F.coalesce(F.sum(F.when(F.trim("v") == "", F.col("_n"))), F.lit(0)).alias("n_blanks"),
        F.count("v").alias("n_distinct"),
        F.sum(F.when(present, F.col("_n") - 1).otherwise(0)).alias("n_duplicates"),
        F.min(sized)["v"].alias("min_text"),
        F.max(sized)["v"].alias("max_text"),
    )


def join_invariants(fact: DataFrame, dim: DataFrame, fact_key: Sequence[str], dim_keys: Sequence[str], tenant: str, dim_tenant: str) -> DataFrame:
    """duplicate_keys, orphan_keys, tenant_violations, join_input_rows, join_output_rows in one row."""
    per_dim = dim.groupBy(*dim_keys).agg(F.count("*").alias("_copies"), F.min(dim_tenant).alias("_t0"), F.max(dim_tenant).alias("_t1"))
    joined = fact.join(per_dim, list(dim_keys), "left")
    rows = joined.agg(
        F.count_if(F.col("_copies").isNull()).alias("orphan_keys"),
        F.count_if((F.col("_t0") != F.col(tenant)) | (F.col("_t1") != F.col(tenant))).alias("tenant_violations"),
        F.count("*").alias("join_input_rows"),
        F.sum(F.coalesce("_copies", F.lit(1))).alias("join_output_rows"),
    )
    repeats = fact.groupBy(*fact_key).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("duplicate_keys"))
    return rows.withColumn("duplicate_keys", repeats.scalar())
