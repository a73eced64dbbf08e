"""The study's tables, reports and models, from patient tables to rate ratios."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratelab.functions.columns import exposure
from ratelab.models.design import (
    NEGATIVE_BINOMIAL,
    POISSON,
    Categorical,
    NaturalSpline,
    Numeric,
    RateModel,
    Term,
)
from ratelab.models.fit import FitResult, fit_slices
from ratelab.models.inference import keep_term, tidy
from ratelab.models.mixed import GAUSSIAN, fit_random_intercept, tidy_mixed
from ratelab.operators.cells import PLACE, link_cells_on, study_strata, sum_cells
from ratelab.operators.filters import keep_period
from ratelab.scratch import Scratch

STRATA = ["quintile", "age_band", "gender"]
PERIOD = ["month", "month_no"]

AGE_SEX = (Categorical("age_band"), Categorical("gender"))
SEASON = (NaturalSpline("month_no", (4.0, 8.0)),)
# Labels of the three adjustment sets, most adjusted first.
ADJUSTMENTS: dict[str, tuple[Term, ...]] = {
    "Age, Sex, Seasonality": AGE_SEX + SEASON,
    "Seasonality": SEASON,
    "None": (),
}


def latest_report(linked: DataFrame, period: int) -> DataFrame:
    """One period by practice and stratum; strata without events stay null."""
    return sum_cells(keep_period(study_strata(linked), period), [*PLACE, *STRATA])


def attendance_table(linked: DataFrame, measure: str = "attends") -> DataFrame:
    """All periods by practice and stratum, zero-filled."""
    return sum_cells(study_strata(linked), [*PERIOD, *PLACE, *STRATA], measure, zero_fill=True)


def admission_table(linked: DataFrame, measure: str = "admits") -> DataFrame:
    """Periods collapsed, zero-filled; ``persons`` are person-periods."""
    return sum_cells(study_strata(linked), [*PLACE, *STRATA], measure, zero_fill=True)


def borough_table(population: DataFrame, activity: DataFrame) -> DataFrame:
    """Monthly borough strata from the two cell tables."""
    keys = [*PERIOD, "borough", *STRATA]
    return link_cells_on(study_strata(population), activity, keys)


def features(table: DataFrame) -> DataFrame:
    """Exposure flags: the most deprived quintile, and the two most deprived."""
    return table.withColumns({"deprived": exposure("quintile", 2), "deprived2": exposure("quintile", 3)})


def model_tables(monthly: DataFrame, yearly: DataFrame, measures: tuple[str, ...] = ("attends", "admits")) -> dict[str, DataFrame]:
    """The tables that specifications name as their ``data``, with all outcomes side by side.

    ``monthly`` and ``yearly`` are cells of single months and of rolling
    years; "collapsed" is the monthly table with its periods summed. Strata
    without events of an outcome are zero.
    """

    def table(cells: DataFrame, keys: list[str]) -> DataFrame:
        events = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]
        return features(study_strata(cells).groupBy(*keys).agg(F.sum("persons").alias("persons"), *events))

    return {
        "monthly": table(monthly, [*PERIOD, *PLACE, *STRATA]),
        "yearly": table(yearly, [*PERIOD, *PLACE, *STRATA]),
        "collapsed": table(monthly, [*PLACE, *STRATA]),
    }


@dataclass(frozen=True)
class Specification:
    """A model of the study: on which table what is fitted, per which group, with which random intercept."""

    model: RateModel
    by: str | None = None
    random: str | None = None
    data: str = "monthly"


def _specification(
    outcome: str,
    family: str,
    exposed: str,
    adjust: tuple[Term, ...] = AGE_SEX,
    extra: tuple[Term, ...] = (),
    **kind,
) -> Specification:
    terms = (*adjust, Numeric(exposed), *extra)
    return Specification(RateModel(outcome, terms, family), **kind)


BOROUGH = (Categorical("borough"),)

SPECIFICATIONS: dict[str, Specification] = {
    # One value per year and stratum.
    "year_poisson": _specification("attends", POISSON, "deprived", data="yearly"),
    "year_poisson_random": _specification("attends", POISSON, "deprived", random="borough", data="yearly"),
    "year_nb": _specification("attends", NEGATIVE_BINOMIAL, "deprived", data="yearly"),
    "year_nb_borough": _specification("attends", NEGATIVE_BINOMIAL, "deprived", by="borough", data="yearly"),
    "year_nb_borough_crude": _specification(
        "attends", NEGATIVE_BINOMIAL, "deprived", (), by="borough", data="yearly"
    ),
    # Periods collapsed, with admissions as second outcome.
    "collapsed_poisson": _specification("attends", POISSON, "deprived", data="collapsed"),
    "collapsed_poisson_random": _specification("attends", POISSON, "deprived", random="borough", data="collapsed"),
    "collapsed_nb_admits": _specification("admits", NEGATIVE_BINOMIAL, "deprived", data="collapsed"),
    "collapsed_nb_random": _specification(
        "attends", NEGATIVE_BINOMIAL, "deprived", random="borough", data="collapsed"
    ),
    # Monthly, exposure to the most deprived quintile.
    "month_poisson": _specification("attends", POISSON, "deprived"),
    "month_poisson_random": _specification("attends", POISSON, "deprived", random="borough"),
    "month_nb": _specification("attends", NEGATIVE_BINOMIAL, "deprived"),
    "month_nb_unseasoned": _specification("attends", NEGATIVE_BINOMIAL, "deprived"),
    "month_gaussian_random": _specification("attends", GAUSSIAN, "deprived", random="borough"),
    "month_nb_borough": _specification("attends", NEGATIVE_BINOMIAL, "deprived", extra=SEASON, by="borough"),
    "month_nb_borough_season": _specification(
        "attends", NEGATIVE_BINOMIAL, "deprived", (), SEASON, by="borough"
    ),
    "month_nb_borough_crude": _specification("attends", NEGATIVE_BINOMIAL, "deprived", (), by="borough"),
    # Monthly, exposure to the two most deprived quintiles.
    "month2_poisson": _specification("attends", POISSON, "deprived2"),
    "month2_poisson_random": _specification("attends", POISSON, "deprived2", extra=SEASON, random="borough"),
    "month2_nb": _specification("attends", NEGATIVE_BINOMIAL, "deprived2"),
    "month2_nb_fixed_borough": _specification("attends", NEGATIVE_BINOMIAL, "deprived2", extra=BOROUGH + SEASON),
    "month2_nb_borough": _specification("attends", NEGATIVE_BINOMIAL, "deprived2", extra=SEASON, by="borough"),
    "month2_nb_borough_season": _specification(
        "attends", NEGATIVE_BINOMIAL, "deprived2", (), SEASON, by="borough"
    ),
    "month2_nb_borough_crude": _specification("attends", NEGATIVE_BINOMIAL, "deprived2", (), by="borough"),
    # The two final models.
    "final_attends": _specification("attends", NEGATIVE_BINOMIAL, "deprived", data="monthly"),
    "final_admits": _specification("admits", NEGATIVE_BINOMIAL, "deprived", data="collapsed"),
}


def run_specification(spec: Specification, data: DataFrame | Mapping[str, DataFrame], method: str = "wald") -> DataFrame:
    """Coefficient table of one specification, over its own of ``model_tables``, or over a table with the feature columns."""
    table = data if isinstance(data, DataFrame) else data[spec.data]
    spark = table.sparkSession
    with Scratch(spark) as scratch:
        if spec.random:
            return tidy_mixed(fit_random_intercept(table, spec.model, spec.random, scratch), spark)
        return _stack(fit_slices(table, spec.model, scratch, spec.by), spark, method=method)


def _stack(parts: Iterator[FitResult], spark: SparkSession, **how) -> DataFrame:
    """One coefficient table; many slices go through a stored table of their own."""
    tables = (tidy(f, spark, **how) for f in parts)
    out, more = next(tables), next(tables, None)
    if more is None:
        return out
    # The caller reads this table after the fits are gone: it stays in the run's folder.
    kept = Scratch(spark).table("coefficients")
    for part in chain((out, more), tables):
        part.write.mode("append").parquet(kept)
    return spark.read.schema(out.schema).parquet(kept)


def rate_ratio(
    table: DataFrame,
    outcome: str = "attends",
    family: str = NEGATIVE_BINOMIAL,
    exposed: str = "deprived",
    adjust: tuple[Term, ...] = AGE_SEX,
    by: str | None = None,
    method: str = "profile",
) -> DataFrame:
    """Rate ratio of the exposed against the rest, overall or in every group of ``by``."""
    spark = table.sparkSession
    model = RateModel(outcome, (*adjust, Numeric(exposed)), family)
    with Scratch(spark) as scratch:
        return keep_term(
            _stack(fit_slices(table, model, scratch, by), spark, method=method, terms=[exposed]), exposed
        )


def adjustment_comparison(
    table: DataFrame, by: str = "borough", exposed: str = "deprived", method: str = "profile", outcome: str = "attends"
) -> DataFrame:
    """Rate ratios per group under each adjustment set, stacked with its label.

    The sets are fitted side by side over the same cells. Where a covariate is
    missing in some rows the sets have different complete cases, and each is
    then fitted to its own.
    """
    spark = table.sparkSession
    terms = {label: (*adjust, Numeric(exposed)) for label, adjust in ADJUSTMENTS.items()}
    every = tuple(dict.fromkeys(t for set_ in terms.values() for t in set_))
    models = {label: RateModel(outcome, t) for label, t in terms.items()}
    full = RateModel(outcome, every)
    counts = table.agg(
        *[
            F.count_if(reduce(and_, [F.col(c).isNotNull() for c in m.covariates])).alias(f"n{i}")
            for i, m in enumerate([full, *models.values()])
        ]
    ).first()
    how = {"method": method, "terms": [exposed]}
    with Scratch(spark) as scratch:
        if len(set(counts)) == 1:
            stacked = _stack(fit_slices(table, full, scratch, by, variants=terms), spark, **how)
        else:
            each = [
                _stack(fit_slices(table, m, scratch, by, f"set{i}"), spark, **how).withColumn(
                    "adjustment", F.lit(label)
                )
                for i, (label, m) in enumerate(models.items())
            ]
            stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
        return keep_term(stacked, exposed)
