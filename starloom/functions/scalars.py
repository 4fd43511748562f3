"""Column helpers: money, ratios, keys, text normalisation, null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(amount: Column | str) -> Column:
    """Double amount to exact integer cents (rounded half away from zero)."""
    return F.round(as_col(amount) * 100).cast("long")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is null on a null or zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def surrogate_key(*parts: Column | str, sep: str = ":") -> Column:
    """md5 of the joined parts; null as soon as one part is null."""
    joined: list[Column] = []
    for part in parts:
        if joined:
            joined.append(F.lit(sep))
        joined.append(as_col(part).cast("string"))
    return F.md5(F.concat(*joined))


def row_hash(*cols: str) -> Column:
    """SHA-256 of the row's JSON form, columns in sorted order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def identifier(name: Column | str) -> Column:
    """Lower-case snake form of a free-text identifier."""
    snake = F.regexp_replace(F.lower(F.trim(as_col(name))), "[^a-z0-9]+", "_")
    return F.regexp_replace(snake, "^_+|_+$", "")


def month_start(d: Column | str) -> Column:
    return F.trunc(as_col(d).cast("date"), "month")


def local_date(ts: Column | str, zone: str) -> Column:
    """Calendar date in ``zone`` of a zone-free UTC timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), as_col(ts)).cast("date")


def iso_date_or_null(text: Column | str) -> Column:
    """Date of canonical ISO text; anything else is null."""
    parsed = F.try_to_date(as_col(text), "yyyy-MM-dd")
    return F.when(F.date_format(parsed, "yyyy-MM-dd") == as_col(text), parsed)


def blank_add(a: Column, b: Column) -> Column:
    """Addition where a one-sided blank counts as zero, both blank stays blank."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def blank_subtract(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))


def blank_multiply(a: Column, b: Column) -> Column:
    return a * b


def blank_divide(a: Column, b: Column, alternate: Column | None = None) -> Column:
    """Quotient, or ``alternate`` (default blank) on a blank or zero divisor."""
    other = F.lit(None).cast("double") if alternate is None else alternate.cast("double")
    return F.when(b.isNull() | (b == 0), other).otherwise(ratio(a, b))


def luhn_ok(candidate: Column) -> Column:
    """Checksum test over the digits of a 13-19 digit number, not all alike."""
    digits = F.regexp_replace(candidate, "[^0-9]", "")
    values = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            (d.cast("int") * 2) % 10 + (d.cast("int") * 2 / 10).cast("int")
        ),
    )
    total = F.aggregate(values, F.lit(0), lambda acc, v: acc + v)
    return (
        F.length(digits).between(13, 19)
        & ~digits.rlike("^(\\d)\\1*$")
        & (total % 10 == 0)
    )
