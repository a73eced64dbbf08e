"""Period calendars: one row per reporting window [start_date, end_date)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

COLUMNS = ("month", "month_no", "start_date", "end_date")


@dataclass(frozen=True)
class Calendar:
    """Periods plus the facts that plans need about them.

    ``width`` is the number of months in each window where windows start in
    consecutive months and are numbered from 1; None for any other calendar.
    """

    periods: DataFrame
    count: int
    first: date
    last: date
    width: int | None = None


def _add_months(day: date, months: int) -> date:
    total = day.year * 12 + day.month - 1 + months
    return date(total // 12, total % 12 + 1, 1)


def rolling(spark: SparkSession, start: date, count: int, width: int) -> Calendar:
    """``count`` windows of ``width`` months, each starting one month after the last."""
    if start.day != 1:
        raise ValueError("a calendar starts on the first day of a month")
    if count < 1 or width < 1:
        raise ValueError("count and width are at least 1")
    first = F.add_months(F.lit(start), F.col("id").cast("int"))
    periods = spark.range(count, numPartitions=1).select(
        first.alias("month"),
        (F.col("id") + 1).cast("int").alias("month_no"),
        first.alias("start_date"),
        F.add_months(first, width).alias("end_date"),
    )
    return Calendar(periods, count, start, _add_months(start, count - 1 + width), width)


def monthly(spark: SparkSession, start: date, count: int) -> Calendar:
    """``count`` calendar months from ``start``."""
    return rolling(spark, start, count, 1)


def spanning(df: DataFrame, when: str, width: int = 1) -> Calendar:
    """Windows of ``width`` months starting in every month the dates cover."""
    facts = df.agg(F.min(when).alias("low"), F.max(when).alias("high")).first()
    low, high = facts["low"], facts["high"]
    if low is None:
        raise ValueError(f"{when} has no dates")
    count = (high.year - low.year) * 12 + high.month - low.month + 1
    return rolling(df.sparkSession, date(low.year, low.month, 1), count, width)


def from_table(df: DataFrame) -> Calendar:
    """Use a stored calendar, after checking that month_no names one window."""
    periods = df.select(*COLUMNS)
    facts = periods.agg(
        F.count("*").alias("rows"),
        F.count_distinct("month_no").alias("numbers"),
        F.sum(F.expr("CASE WHEN start_date < end_date THEN 0 ELSE 1 END")).alias("bad"),
        F.min("start_date").alias("first"),
        F.max("end_date").alias("last"),
    ).first()
    if not facts["rows"]:
        raise ValueError("the calendar is empty")
    if facts["rows"] != facts["numbers"]:
        raise ValueError("month_no must identify exactly one period")
    if facts["bad"]:
        raise ValueError("every period needs start_date < end_date")
    return Calendar(periods, facts["rows"], facts["first"], facts["last"])
