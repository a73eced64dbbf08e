"""Column expressions: age bands, exposures, rates, intervals, sums."""

from __future__ import annotations

from datetime import date
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F


def age_band(dob: str, asof: date, width: int = 15) -> Column:
    """Lower edge of the age band, with age counted in year boundaries passed."""
    return F.expr(f"(year(DATE '{asof.isoformat()}') - year({dob})) div {width} * {width}").cast("int")


def exposure(quintile: str, below: int) -> Column:
    """1 for quintiles under ``below``, 0 for the rest, null where unknown."""
    return F.when(F.col(quintile) < below, 1).when(F.col(quintile) >= below, 0)


def nonblank(name: str) -> Column:
    """True for text that is neither null, empty nor only blanks."""
    return F.trim(F.col(name)) != ""


def starts_with_any(name: str, prefixes: tuple[str, ...]) -> Column:
    """Prefix list as a disjunction that the parquet reader can evaluate."""
    test = F.lit(False)
    for prefix in prefixes:
        test = test | F.col(name).startswith(prefix)
    return test


def caseless(df: DataFrame, *names: str) -> DataFrame:
    """Give text columns a collation that ignores case and trailing blanks."""
    return df.withColumns({n: F.collate(n, "UTF8_LCASE_RTRIM") for n in names})


def normal_quantile(level: float) -> float:
    """Two-sided standard normal quantile for a confidence level."""
    return NormalDist().inv_cdf(level + (1 - level) / 2)


def rate(events: str, persons: str) -> Column:
    return F.try_divide(F.col(events).cast("double"), F.col(persons).cast("double"))


def wilson(events: str, persons: str, level: float = 0.95) -> tuple[Column, Column]:
    """Wilson score limits; null where the score equation has no real root."""
    z = normal_quantile(level)
    z2 = z * z
    o = F.col(events).cast("double")
    n = F.col(persons).cast("double")
    inner = z2 + 4 * o * (1 - F.try_divide(o, n))
    root = F.when(inner >= 0, F.sqrt(inner))
    centre = 2 * o + z2
    width = 2 * (n + z2)
    return (
        F.try_divide(centre - z * root, width),
        F.try_divide(centre + z * root, width),
    )


def sum_known(name: str) -> Column:
    """Sum that skips missing values; 0 when all are missing."""
    return F.coalesce(F.sum(name), F.lit(0))


def sum_strict(name: str) -> Column:
    """Sum that is missing as soon as one value is missing."""
    return F.when(F.count(F.lit(1)) == F.count(name), F.sum(name))
