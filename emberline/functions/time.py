"""Weeks, cohorts and dates.

A week is the integer number of Mondays since 1970-01-05; labels are only for display.
All arithmetic is on dates, so no result depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first Monday after the epoch, and the cohort window in months.
EPOCH_MONDAY = "1970-01-05"
COHORT_MONTHS_BEFORE = 12
COHORT_MONTHS = 39


def _monday() -> Column:
    return F.lit(EPOCH_MONDAY).cast("date")


def week_idx(day: Column) -> Column:
    """Monday-based week number of a date."""
    return F.floor(F.datediff(day, _monday()) / 7).cast("long")


def week_shift(week: Column, lag: int) -> Column:
    """Week ``lag`` weeks later (earlier when negative)."""
    return week + F.lit(lag).cast("long")


def week_to_monday(week: Column) -> Column:
    return F.date_add(_monday(), (week * 7).cast("int"))


def week_to_sunday(week: Column) -> Column:
    """The Sunday that closes a week."""
    return F.date_add(_monday(), (week * 7 + 6).cast("int"))


def iso_week_label(day: Column) -> Column:
    """``YYYY_WW`` with the ISO year, so labels do not break at New Year."""
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    return F.concat(year, F.lit("_"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def sunday_on_or_after(day: Column) -> Column:
    """Label of the Sunday-ending week that holds ``day``."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def week_spine(df: DataFrame, start: str, end: str, name: str = "sunday") -> DataFrame:
    """One row per Sunday between two date columns; none when the interval holds no Sunday."""
    first = sunday_on_or_after(F.col(start))
    days = F.when(first <= F.col(end), F.sequence(first, F.col(end), F.expr("interval 7 days")))
    return df.withColumn(name, F.explode(days))


def month_start(day: Column) -> Column:
    return F.trunc(day, "month").cast("date")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def quarter_idx(day: Column) -> Column:
    """Consecutive number of a three-month block."""
    return (F.year(day) * 4 + F.quarter(day)).cast("long")


def cohort_label(day: Column) -> Column:
    """``YYYY-Q``."""
    return F.concat(F.year(day).cast("string"), F.lit("-"), F.quarter(day).cast("string"))


def cohort_window(cohort: Column) -> Column:
    """Struct(start, end) of first days of month; ``end`` is exclusive.

    The window opens 12 months before the cohort's quarter and spans 39 months.
    """
    parts = F.split(cohort, "-")
    quarter_month = (parts.getItem(1).cast("int") - 1) * 3 + 1
    quarter_start = F.make_date(parts.getItem(0).cast("int"), quarter_month, F.lit(1))
    start = F.add_months(quarter_start, -COHORT_MONTHS_BEFORE)
    return F.struct(start.alias("start"), F.add_months(start, COHORT_MONTHS).alias("end"))


def epoch_to_date(seconds: Column) -> Column:
    """UTC calendar date of epoch seconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def date_from_path(path: Column) -> Column:
    """First ``YYYYMMDD`` in a file name; null when there is none."""
    digits = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{8})", 1)
    return F.try_to_date(F.when(digits != "", digits), "yyyyMMdd")


def person_period_duration(sunday: Column, start: Column, end: Column) -> Column:
    """Observed days of a week that an activation or the window edge may cut short."""
    return F.least(F.datediff(sunday, start), F.lit(7), F.datediff(end, sunday)).cast("long")
