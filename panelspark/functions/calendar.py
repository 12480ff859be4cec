"""Weekday arithmetic in closed form: no calendar table and no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.scalar import col

_MONDAY = "1970-01-05"


def _weekdays_before(day: Column) -> Column:
    """Number of Monday-to-Friday days in [1970-01-05, day)."""
    k = F.datediff(day, F.lit(_MONDAY).cast("date"))
    return F.floor(k / 7) * 5 + F.least(F.pmod(k, F.lit(7)), F.lit(5))


def _weekday_at(index: Column) -> Column:
    """Date of the weekday with the given zero-based index."""
    offset = F.floor(index / 5) * 7 + F.pmod(index, F.lit(5))
    return F.date_add(F.lit(_MONDAY).cast("date"), offset.cast("int"))


def business_days_between(start, end) -> Column:
    """Inclusive weekday count minus one; 0 where either date is missing."""
    a, b = col(start).cast("date"), col(end).cast("date")
    n = _weekdays_before(F.date_add(b, 1)) - _weekdays_before(a) - 1
    # an empty range counts zero days before the minus one
    return F.coalesce(F.when(n < -1, F.lit(-1)).otherwise(n), F.lit(0)).cast("long")


def add_business_days(day, n) -> Column:
    d = col(day).cast("date")
    return _weekday_at(_weekdays_before(F.date_add(d, 1)) - 1 + n)


def subtract_business_days(day, n) -> Column:
    return _weekday_at(_weekdays_before(col(day).cast("date")) - n)


def week_ending_friday(day) -> Column:
    return F.next_day(F.date_sub(col(day).cast("date"), 1), "FRI")


def month_key(day) -> Column:
    return F.date_format(col(day), "yyyy-MM")


def days_to_month_end(day) -> Column:
    d = col(day).cast("date")
    return F.datediff(F.last_day(d), d)
