"""Month indices, calendars and leap years, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from 0001-01-01 (day 1) to the first day of the other calendar's year 1, month 1: its epoch in Gregorian days.
OTHER_EPOCH = 2796


def month_index(year: Column, month: Column) -> Column:
    """Months since 1900, January 1900 as 1."""
    return (year - 1900) * 12 + month


def year_of(index: Column) -> Column:
    return F.floor((index - 1) / 12) + 1900


def month_of(index: Column) -> Column:
    return (index - 1) % 12 + 1


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def other_to_gregorian(year: Column, month: Column, day: Column) -> Column:
    """A date of a calendar of twelve 30-day months and a short thirteenth, with 366 days when year % 4 is 3."""
    days = F.lit(OTHER_EPOCH) + 365 * (year - 1) + F.floor(year / 4) + 30 * (month - 1) + day - 1
    return F.date_add(F.lit("0001-01-01").cast("date"), (days - 1).cast("int"))


def overlap_months(start: Column, months: Column, year: Column) -> Column:
    """How many months of a window (start as a month index) fall in a calendar year."""
    first = month_index(year, F.lit(1))
    return F.greatest(F.lit(0), F.least(start + months - 1, first + 11) - F.greatest(start, first) + 1)


#: Days before each month of a common year.
BEFORE_MONTH = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]


def day_models(year: Column, month: Column, day: Column) -> dict[str, Column]:
    """Day numbers by three models of month lengths: months of 30 days, those of a common year, those of the year itself."""
    start = 365 * (year - 1) + F.floor((year - 1) / 4) - F.floor((year - 1) / 100) + F.floor((year - 1) / 400)
    common = F.get(F.array(*map(F.lit, BEFORE_MONTH)), (month - 1).cast("int"))
    return {"thirty": start + 30 * (month - 1) + day, "common": start + common + day, "leap": start + common + day + (is_leap(year) & (month > 2)).cast("int")}
