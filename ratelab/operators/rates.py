"""Rates with Wilson score limits by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratelab.functions.columns import rate, sum_known, wilson


def rate_table(
    df: DataFrame,
    by: list[str],
    events: str = "attends",
    persons: str = "persons",
    divisor: int = 1,
    level: float = 0.95,
) -> DataFrame:
    """Summed persons and events by group, their ratio and its limits.

    Missing values are skipped in the sums. ``divisor`` scales both sums before
    the limits are taken, which leaves the ratio alone but widens the limits.
    """
    sums = [sum_known(persons).alias(persons), sum_known(events).alias(events)]
    table = df.groupBy(*by).agg(*sums)
    if divisor != 1:
        table = table.withColumns({c: F.col(c) / F.lit(divisor) for c in (persons, events)})
    low, high = wilson(events, persons, level)
    return table.select(
        *by, persons, events, rate(events, persons).alias("prop"), low.alias("lcl"), high.alias("ucl")
    )
