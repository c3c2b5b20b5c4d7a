"""Calendar columns built from Spark's own date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_week(date: Column) -> Column:
    """``YYYY-WW`` with Monday-first weeks 00-53 (``strftime`` ``%Y-%W``)."""
    week = F.floor((F.dayofyear(date) + 6 - F.weekday(date)) / 7)
    return F.concat(
        F.lpad(F.year(date).cast("string"), 4, "0"),
        F.lit("-"),
        F.lpad(week.cast("string"), 2, "0"),
    )


def whole_periods(later: Column, earlier: Column, days: int) -> Column:
    """Whole ``days``-long periods from ``earlier`` to ``later``; floors below zero too."""
    return F.floor(F.datediff(later, earlier) / days).cast("int")


def month_start(year: Column, month: Column) -> Column:
    """First day of the month; NULL where there is no such month."""
    exists = month.between(1, 12) & year.between(1, 9999)
    return F.when(exists, F.make_date(year, F.when(exists, month).otherwise(1), F.lit(1)))


def week_before(year: Column, week: Column) -> Column:
    """Monday of ``%W`` week ``week`` of ``year``, less seven days; NULL where there is no such week."""
    exists = week.between(0, 53) & year.between(1, 9999)
    eve = F.date_sub(F.make_date(F.when(exists, year), F.lit(1), F.lit(1)), 1)
    return F.date_add(F.next_day(eve, "MON"), (7 * (week - 2)).cast("int"))


def date_parts(date: Column) -> dict[str, Column]:
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day": F.dayofmonth(date),
        "week_of_year": F.weekofyear(date),
    }
