"""Dataset comparison: keyed diff, lanes, scorecards, result contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.operators.aggregates import worst_status
from starloom.operators.sets import union_checks

NUMERIC = ("integer", "decimal", "number")


@dataclass(frozen=True)
class ColumnRule:
    """Type, null rule and tolerance of one compared column.

    A tolerance is taken as the decimal it is written as, so 0.29 is 0.29.
    """

    type: str
    nullable: bool = True
    abs_tolerance: float | str | Decimal = 0
    rel_tolerance: float | str | Decimal = 0

    @property
    def tolerances(self) -> tuple[Decimal, Decimal]:
        return Decimal(str(self.abs_tolerance)), Decimal(str(self.rel_tolerance))


@dataclass(frozen=True)
class ResultContract:
    columns: Mapping[str, ColumnRule]
    keys: Sequence[str]
    category: str = "correctness"
    metrics: Mapping[str, int] = field(default_factory=dict)

    @property
    def values(self) -> list[str]:
        return [c for c in self.columns if c not in self.keys]


def _digits(kind: T.DataType) -> tuple[int, int] | None:
    """Whole and fractional digits of an exact number type; None for others."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    return {T.ByteType: (3, 0), T.ShortType: (5, 0), T.IntegerType: (10, 0), T.LongType: (19, 0)}.get(type(kind))


def within_tolerance(expected: Column, actual: Column, rule: ColumnRule, kinds: tuple[T.DataType, T.DataType] | None = None) -> Column:
    """``|a-b| <= max(abs, rel*|expected|)``; null equals only null.

    With the types of both sides given and both of them whole numbers or decimals, the
    test is exact: tolerances become whole numbers of a power of ten and both sides of
    the comparison are decimals. More than 38 digits are refused. Other numbers are
    compared as doubles.
    """
    absolute, relative = rule.tolerances
    if rule.type not in NUMERIC or not (absolute or relative):
        return expected.eqNullSafe(actual)
    both_null = expected.isNull() & actual.isNull()
    digits = [_digits(k) for k in kinds] if kinds else [None]
    if None in digits:
        allowed = F.greatest(F.lit(float(absolute)), F.lit(float(relative)) * F.abs(expected))
        return both_null | F.coalesce(F.abs(expected - actual) <= allowed, F.lit(False))
    places = max(0, -absolute.as_tuple().exponent, -relative.as_tuple().exponent)
    whole, scale = max(d[0] for d in digits) + 1, max(d[1] for d in digits)
    factors = [int(t.scaleb(places)) for t in (Decimal(1), relative, absolute)]
    needed = whole + scale + max(len(str(f)) for f in factors) + 1
    if needed > 38:
        raise ValueError(f"the tolerance of a {rule.type} column needs {needed} digits; give a narrower type or fewer decimals")
    held = f"decimal({whole + scale},{scale})"
    by = lambda c, f: c * F.lit(Decimal(f)).cast(f"decimal({len(str(f))},0)")
    gap = by(F.abs(expected.cast(held) - actual.cast(held)), factors[0])
    allowed = F.greatest(by(F.abs(expected.cast(held)), factors[1]), F.lit(Decimal(factors[2])).cast(f"decimal({len(str(factors[2]))},0)"))
    return both_null | F.coalesce(gap <= allowed, F.lit(False))


LEAF_BITS = 18


def _leaf(keys: Sequence[str]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - LEAF_BITS)


def leaf_digests(df: DataFrame, contract: ResultContract) -> DataFrame:
    """A digest per bucket of keys: ``leaf``, ``digest``, and ``refused`` where a key is null or may repeat.

    Level one folds the rows of a key's hash to their number and two hashes of all compared
    columns; level two adds those up per leaf. Only hashes leave a map task, never a value;
    a key that many rows share is folded there first. Equal digests mean equal rows up to a
    coincidence of 128 bits.
    """
    keys, columns = list(contract.keys), [*contract.keys, *contract.values]
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    rows = df.select(F.xxhash64(*keys).alias("_k"), F.xxhash64(*columns).cast("decimal(20,0)").alias("_h"), F.xxhash64(F.lit(1), *columns).alias("_g"), null.alias("_null"))
    of_key = rows.groupBy("_k").agg(F.count("*").alias("_n"), F.sum("_h").alias("_h"), F.bit_xor("_g").alias("_g"), F.max("_null").alias("_null"))
    folded = of_key.groupBy(F.shiftrightunsigned("_k", 64 - LEAF_BITS).alias("leaf")).agg(
        F.sum("_n").alias("n"), F.sum("_h").alias("h"), F.bit_xor("_g").alias("g"), F.max((F.col("_n") > 1) | F.col("_null")).alias("refused"))
    return folded.select("leaf", F.struct("n", "h", "g").alias("digest"), "refused")


def differing_leaves(expected: DataFrame, actual: DataFrame, contract: ResultContract) -> DataFrame:
    """Leaves that hold a finding or may hold one; at most ``2 ** LEAF_BITS`` rows."""
    e = leaf_digests(expected, contract).select(F.col("leaf").alias("_el"), F.struct("digest", "refused").alias("_e"))
    a = leaf_digests(actual, contract).select(F.col("leaf").alias("_al"), F.struct("digest", "refused").alias("_a"))
    joined = e.join(a, F.col("_el") == F.col("_al"), "full_outer")
    same = F.col("_e.digest").eqNullSafe(F.col("_a.digest")) & ~F.coalesce("_e.refused", F.lit(False)) & ~F.coalesce("_a.refused", F.lit(False))
    return joined.where(~same).select(F.coalesce("_el", "_al").alias("_leaf"))


def _aligned(expected: DataFrame, actual: DataFrame, contract: ResultContract) -> tuple[DataFrame, DataFrame]:
    """Both sides' contract columns; numbers of unlike types are cast to one, so that equal ones have equal hashes."""
    kinds = [{f.name: f.dataType for f in df.schema} for df in (expected, actual)]
    number = lambda t: isinstance(t, T.NumericType)
    unlike = [c for c in contract.columns if kinds[0][c] != kinds[1][c] and number(kinds[0][c]) and number(kinds[1][c])]
    if not unlike:
        return expected.select(*contract.columns), actual.select(*contract.columns)
    shared = expected.select(*unlike).limit(0).unionByName(actual.select(*unlike).limit(0)).schema
    to = {f.name: f.dataType for f in shared}
    cast = lambda df: df.select(*[F.col(c).cast(to[c]).alias(c) if c in to else F.col(c) for c in contract.columns])
    return cast(expected), cast(actual)


def keyed_diff(expected: DataFrame, actual: DataFrame, contract: ResultContract) -> DataFrame:
    """One row per missing key, extra key, differing value, repeated key and null key.

    Both sides are first compared by digests of key buckets (``differing_leaves``); only
    rows of buckets that differ go on, by a broadcast of the leaves, whose number is
    bounded. So equal sides shuffle hashes alone, and nearly equal ones little more. What
    goes on is folded to one row per key, then joined on the same partitioning. A key that
    repeats on either side gives one ``duplicate_key`` finding with both counts, a key with
    a null one ``null_key`` finding; neither is compared further, so nothing multiplies.
    """
    keys, values = list(contract.keys), contract.values
    expected, actual = _aligned(expected, actual, contract)
    leaves = F.broadcast(differing_leaves(expected, actual, contract))  # at most 2 ** LEAF_BITS rows of one number
    kinds = {c: (expected.schema[c].dataType, actual.schema[c].dataType) for c in values}

    def side(df: DataFrame, mark: str) -> DataFrame:
        df = df.join(leaves, _leaf(keys) == F.col("_leaf"), "left_semi")
        folded = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(v).alias(v) for v in values])
        return folded.select(*[F.col(k).alias(f"_{mark}_{k}") for k in keys], F.struct("_n", *values).alias(f"_{mark}"))

    on = [F.col(f"_e_{k}").eqNullSafe(F.col(f"_a_{k}")) for k in keys]
    joined = side(expected, "e").join(side(actual, "a"), on, "full_outer").select(
        *[F.coalesce(f"_e_{k}", f"_a_{k}").alias(k) for k in keys], "_e", "_a"
    )

    def finding(kind: str, column: str | None = None, field: str | None = None) -> Column:
        def text(side: str) -> Column:
            return F.lit(None).cast("string") if field is None else F.col(side)[field].cast("string")

        return F.struct(
            F.lit(kind).alias("kind"), F.lit(column).cast("string").alias("column_name"),
            text("_e").alias("expected"), text("_a").alias("actual"),
        )

    changed = F.array_compact(F.array(*[
        F.when(~within_tolerance(F.col("_e")[c], F.col("_a")[c], contract.columns[c], kinds[c]), finding("value_mismatch", c, c))
        for c in values
    ])) if values else F.array().cast("array<struct<kind:string,column_name:string,expected:string,actual:string>>")
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    repeated = F.coalesce(F.col("_e._n") > 1, F.lit(False)) | F.coalesce(F.col("_a._n") > 1, F.lit(False))
    findings = (
        F.when(has_null, F.array(finding("null_key", None, "_n")))
        .when(repeated, F.array(finding("duplicate_key", None, "_n")))
        .when(F.col("_a").isNull(), F.array(finding("missing_key")))
        .when(F.col("_e").isNull(), F.array(finding("extra_key")))
        .otherwise(changed)
    )
    return joined.select(*keys, F.explode(findings).alias("_f")).select(*keys, "_f.*")


def diff_summary(diff: DataFrame, case: str, category: str) -> DataFrame:
    """Finding counts of one case; an empty diff still gives its row."""
    return diff.agg(
        F.count_if(F.col("kind") == "missing_key").alias("missing_keys"),
        F.count_if(F.col("kind") == "extra_key").alias("extra_keys"),
        F.count_if(F.col("kind") == "value_mismatch").alias("value_mismatches"),
        F.count_if(F.col("kind").isin("duplicate_key", "null_key")).alias("refused_keys"),
    ).select(
        F.lit(case).alias("case_id"), F.lit(category).alias("category"), "*",
        (F.col("missing_keys") + F.col("extra_keys") + F.col("value_mismatches") + F.col("refused_keys") == 0).alias("passed"),
    )


def category_summary(cases: DataFrame) -> DataFrame:
    return cases.groupBy("category").agg(
        F.count("*").alias("expected"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed")
    )


def parity_lanes(baseline: DataFrame, lanes: Mapping[str, DataFrame | None], contract: ResultContract, case: str) -> DataFrame:
    """Status of each lane against the baseline; a missing lane is pending."""
    rows = []
    for lane, observed in lanes.items():
        if observed is None:
            rows.append(baseline.sparkSession.range(1).select(
                F.lit(case).alias("case_id"), F.lit(lane).alias("lane"),
                F.lit(0).cast("long").alias("row_count"), F.lit(0).cast("long").alias("n_findings"),
                F.lit("pending").alias("status")))
            continue
        found = keyed_diff(baseline, observed, contract).agg(F.count("*").alias("n_findings"))
        size = observed.agg(F.count("*").alias("row_count")).withColumn("n_findings", found.scalar())
        rows.append(size.select(
            F.lit(case).alias("case_id"), F.lit(lane).alias("lane"), "row_count", "n_findings",
            F.when(F.col("n_findings") > 0, "failed").otherwise("passed").alias("status")))
    return union_checks(rows)


def parity_cases(lanes: DataFrame) -> DataFrame:
    return lanes.groupBy("case_id").agg(worst_status("status").alias("status"))


def parity_scorecard(crosswalk: DataFrame, checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pass / fail / unsupported / pending per crosswalk item.

    ``checks`` has one row per (item, comparison) with ``check_status``. An item
    without any comparison is unsupported and not required; a stale item fails.
    Failed beats unsupported beats pending.
    """
    per_item = checks.groupBy(*keys).agg(
        F.count("*").alias("case_count"),
        F.count_if(F.col("check_status") == "failed").alias("_failed"),
        F.count_if(F.col("check_status") == "unsupported").alias("_unsupported"),
        F.count_if(F.col("check_status") == "pending").alias("_pending"),
    )
    joined = crosswalk.join(per_item, list(keys), "left").withColumn("case_count", F.coalesce("case_count", F.lit(0)))
    status = (
        F.when(F.col("is_stale") | (F.col("_failed") > 0) | (F.col("mapping_status") == "failed"), "fail")
        .when((F.col("case_count") == 0) | (F.col("_unsupported") > 0) | (F.col("mapping_status") == "unsupported"), "unsupported")
        .when((F.col("_pending") > 0) | (F.col("mapping_status") != "mapped"), "pending")
        .otherwise("pass")
    )
    return joined.select(*keys, "case_count", (F.col("case_count") > 0).alias("is_required"), status.alias("status"))


def scorecard_status(scorecard: DataFrame) -> DataFrame:
    """Counts per status and the worst status among required items."""
    required = F.col("is_required")
    return scorecard.agg(
        F.count_if(F.col("status") == "pass").alias("n_pass"),
        F.count_if(F.col("status") == "fail").alias("n_fail"),
        F.count_if(F.col("status") == "pending").alias("n_pending"),
        F.count_if(F.col("status") == "unsupported").alias("n_unsupported"),
        F.when(F.max((F.col("status") == "fail") & required), "fail")
        .when(F.max((F.col("status") == "unsupported") & required), "unsupported")
        .when(F.max((F.col("status") == "pending") & required), "pending")
        .otherwise("pass").alias("overall"),
    )


FITS = {
    "integer": lambda c: c.try_cast("decimal(38,0)").isNotNull() & (c.try_cast("double") == F.floor(c.try_cast("double"))),
    "decimal": lambda c: c.try_cast("double").isNotNull(),
    "number": lambda c: c.try_cast("double").isNotNull() & ~F.isnan(c.try_cast("double")),
    "boolean": lambda c: c.cast("string").isin("true", "false"),
    "date": lambda c: F.date_format(F.try_to_date(c.cast("string"), "yyyy-MM-dd"), "yyyy-MM-dd") == c.cast("string"),
    "string": lambda c: c.isNotNull(),
}


def row_faults(df: DataFrame, contract: ResultContract, *, allow_null_keys: bool = False) -> dict[str, Column]:
    """Per type and null rule of the contract, the test that a row breaks it."""
    missing = set(contract.columns) ^ set(df.columns)
    if missing:
        raise ValueError(f"columns differ from the contract: {sorted(missing)}")
    out: dict[str, Column] = {}
    for name, rule in contract.columns.items():
        c = F.col(name)
        out[f"type:{name}"] = c.isNotNull() & ~F.coalesce(FITS[rule.type](c), F.lit(False))
        if not rule.nullable or (name in contract.keys and not allow_null_keys):
            out[f"null:{name}"] = c.isNull()
    return out


def contract_violations(df: DataFrame, contract: ResultContract, *, allow_null_keys: bool = False) -> DataFrame:
    """Counts of broken schema, type, null, grain and metric rules, one row per rule.

    One aggregate holds all row rules and metrics; the grain is a second one, by key.
    """
    faults = row_faults(df, contract, allow_null_keys=allow_null_keys)
    metrics = {f"metric:{m}": F.when(F.sum(m).eqNullSafe(F.lit(v)), 0).otherwise(1).cast("long") for m, v in contract.metrics.items()}
    aggs = {**{rule: F.count_if(test) for rule, test in faults.items()}, **metrics}
    checks = df.agg(*[e.alias(n) for n, e in aggs.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in aggs)
    out = checks.selectExpr(f"stack({len(aggs)}, {pairs}) AS (rule, violations)")
    repeats = df.groupBy(*contract.keys).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.count("*").alias("violations"))
    return out.unionByName(repeats.select(F.lit("duplicate_grain").alias("rule"), "violations"))


def value_coverage(fields: DataFrame, checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Preserved fields with the number of exact (tolerance-free) checks on them."""
    exact = checks.where((F.col("abs_tolerance") == 0) & (F.col("rel_tolerance") == 0))
    per_field = exact.groupBy(*keys).agg(F.count("*").alias("n_exact_checks"))
    return fields.join(per_field, list(keys), "left").select(
        *keys, F.coalesce("n_exact_checks", F.lit(0)).alias("n_exact_checks"),
        F.col("n_exact_checks").isNotNull().alias("is_covered"),
    )


def overlap_rates(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched keys over A, over B and over their union, from one tagged aggregate."""
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    sides = tagged.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    counts = sides.agg(
        F.sum(F.col("_a") * F.col("_b")).alias("matched"), F.sum("_a").alias("in_a"),
        F.sum("_b").alias("in_b"), F.count("*").alias("in_union"),
    )
    share = lambda d: F.col("matched").cast("double") / F.nullif(F.col(d).cast("double"), F.lit(0.0))
    return counts.select("*", share("in_a").alias("of_a"), share("in_b").alias("of_b"), share("in_union").alias("of_union"))
