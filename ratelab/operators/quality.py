"""Listings and checks used to find gaps in the inputs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from ratelab.functions.columns import sum_strict


def factor_levels(df: DataFrame, name: str) -> DataFrame:
    """Distinct known values in order; numbers sort as numbers."""
    return df.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name)


def strict_totals(df: DataFrame, by: list[str], *measures: str) -> DataFrame:
    """Sums by group that turn missing when any value is missing."""
    return df.groupBy(*by).agg(*[sum_strict(m).alias(m) for m in measures])


def value_range(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.min(name).alias(f"min_{name}"), F.max(name).alias(f"max_{name}"))


def rows_per(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def wide_strata(df: DataFrame, index: str, parts: Sequence[str], measure: str) -> DataFrame:
    """Strict sums by ``index`` with one column per combination of ``parts`` that occurs.

    Column names join the values with underscores, a missing one as ``NA``, in
    the order of the values. One aggregate finds the combinations; nothing in
    the data is left out. They become columns, so their number is for the
    caller to keep sensible.
    """
    summed = df.groupBy(index, *parts).agg(sum_strict(measure).alias("total"))
    found = summed.select(*parts).distinct().orderBy(*parts).collect()
    names = ["_".join("NA" if v is None else str(v) for v in r) for r in found]
    if len(set(names)) < len(names):
        raise ValueError(f"values of {parts} give the same column name twice")
    here = lambda r: reduce(and_, [F.col(p).eqNullSafe(F.lit(v)) for p, v in zip(parts, r)])
    # A combination is one row per index at most, so max only picks it.
    columns = [F.max(F.when(here(r), F.col("total"))).alias(n) for r, n in zip(found, names)]
    return summed.groupBy(index).agg(*columns) if columns else summed.select(index).distinct()


def missing_numerator(
    df: DataFrame, by: list[str], persons: str = "persons", events: str = "attends"
) -> DataFrame:
    """Groups that have people but not a single event."""
    totals = df.groupBy(*by).agg(F.sum(persons).alias(persons), F.sum(events).alias(events))
    none = F.col(events).isNull() | (F.col(events) == 0)
    return totals.filter((F.col(persons) > 0) & none).select(*by, persons)


def periods_without_events(population: DataFrame, activity: DataFrame, *by: str) -> DataFrame:
    """Periods (or other ``by`` groups) of the population that no activity row has."""
    return population.select(*by).distinct().join(activity.select(*by).distinct(), list(by), "left_anti")
