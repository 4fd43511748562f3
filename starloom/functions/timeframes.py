"""Named timeframes of a date or zone-free timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.scalars import as_col

# Weekday names in the order of their numbers.
WEEK_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _week_start(d: Column, first_day: str) -> Column:
    shift = WEEK_DAYS.index(first_day)
    return F.date_sub(d, (F.weekday(d) - shift + 7) % 7)


def timeframe(ts: Column | str, name: str, *, week_start_day: str = "monday", fiscal_month_offset: int | None = None) -> Column:
    """Value of one timeframe; the fiscal ones need an explicit month offset."""
    c = as_col(ts)
    d = c.cast("date")
    if name in ("fiscal_quarter", "fiscal_year"):
        if fiscal_month_offset is None:
            raise ValueError(f"{name} needs fiscal_month_offset")
        shifted = F.add_months(d, -fiscal_month_offset)
        return F.quarter(shifted) if name == "fiscal_quarter" else F.year(shifted)
    quarter_start = F.trunc(d, "quarter")
    frames = {
        "raw": c,
        "date": d,
        "millisecond": F.date_trunc("millisecond", c),
        "second": F.date_trunc("second", c),
        "minute": F.date_trunc("minute", c),
        "hour": F.date_trunc("hour", c),
        "week": _week_start(d, week_start_day),
        "month": F.trunc(d, "month"),
        "quarter": quarter_start,
        "year": F.trunc(d, "year"),
        "hour_of_day": F.hour(c),
        "day_of_week_name": F.date_format(d, "EEEE"),
        "day_of_week_num": (F.weekday(d) - WEEK_DAYS.index(week_start_day) + 7) % 7 + 1,
        "day_of_month": F.dayofmonth(d),
        "day_of_quarter": F.datediff(d, quarter_start) + 1,
        "day_of_year": F.dayofyear(d),
        "month_name": F.date_format(d, "MMMM"),
        "month_num": F.month(d),
        "quarter_of_year": F.quarter(d),
    }
    if name not in frames:
        raise ValueError(f"unknown timeframe {name!r}")
    return frames[name]
