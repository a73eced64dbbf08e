"""Period and completeness filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F


def in_month(name: str, year: int, month: int) -> Column:
    """True within one calendar month, as a range the parquet reader can use."""
    following = date(year + month // 12, month % 12 + 1, 1)
    return (F.col(name) >= F.lit(date(year, month, 1))) & (F.col(name) < F.lit(following))


def keep_month(df: DataFrame, year: int, month: int, name: str = "month") -> DataFrame:
    return df.filter(in_month(name, year, month))


def drop_month(df: DataFrame, year: int, month: int, name: str = "month") -> DataFrame:
    """All rows outside one calendar month; rows without a month are dropped too."""
    return df.filter(~in_month(name, year, month))


def keep_period(df: DataFrame, number: int, name: str = "month_no") -> DataFrame:
    return df.filter(F.col(name) == number)


def latest_period(df: DataFrame, name: str = "month") -> DataFrame:
    """Rows of the latest period present."""
    # One aggregate row, so the broadcast has a fixed size.
    last = df.agg(F.max(name).alias("_last"))
    return df.join(F.broadcast(last), F.col(name) == F.col("_last")).drop("_last")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with a missing model variable."""
    return df.dropna(subset=columns)
