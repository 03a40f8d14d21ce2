"""Calendar expressions. Every "today" is an explicit ``as_of`` date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(value: dt.date | str) -> Column:
    return F.lit(str(value)).cast("date")


def days_between(start: Column, end: Column) -> Column:
    return F.date_diff(end, start)


def calendar_years_between(start: Column, end: Column) -> Column:
    """Difference of the year numbers, not of completed years."""
    return F.year(end) - F.year(start)


def calendar_months_between(start: Column, end: Column) -> Column:
    """Difference of the month numbers, not of completed months."""
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def week_start(d: Column) -> Column:
    """Monday of the week."""
    return F.trunc(d, "week")


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "quarter")


def year_start(d: Column) -> Column:
    return F.trunc(d, "year")


GRAINS = {
    "day": lambda d: d,
    "week": week_start,
    "month": month_start,
    "quarter": quarter_start,
    "year": year_start,
}


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def date_key(d: Column) -> Column:
    """yyyymmdd as an integer."""
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def one_year_earlier(d: Column) -> Column:
    """Same day of the year before; 29 February maps to 28 February."""
    return F.add_months(d, -12)


def day_of_week(d: Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return F.dayofweek(d) - 1


def is_weekend(d: Column) -> Column:
    return F.dayofweek(d).isin(1, 7)


# The fiscal year starts in April.
def fiscal_quarter(d: Column) -> Column:
    return F.concat(F.lit("FQ"), F.quarter(F.add_months(d, -3)).cast("string"))


def fiscal_year(d: Column) -> Column:
    return F.year(F.add_months(d, -3))


def season(d: Column) -> Column:
    """Meteorological season of the northern hemisphere: December starts Winter."""
    turn = F.floor((F.month(d) % 12) / 3).cast("int")
    names = F.array(*[F.lit(s) for s in ("Winter", "Spring", "Summer", "Autumn")])
    return F.element_at(names, turn + 1)


def in_year_of(d: Column, as_of: dt.date, years_back: int = 0) -> Column:
    """``d`` lies in the calendar year of ``as_of``; written as a range so that files are pruned."""
    year = as_of.year - years_back
    return (d >= day(dt.date(year, 1, 1))) & (d <= day(dt.date(year, 12, 31)))
