"""Rate models as column lists, and their design as column expressions.

Cells are compressed exactly before fitting: equal (covariates, persons,
events) become one row with a frequency. The design itself is never stored;
every term is an expression over the covariate columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from ratelab.operators.filters import complete_cases

POISSON = "poisson"
NEGATIVE_BINOMIAL = "negative_binomial"
INTERCEPT = "(Intercept)"
# Columns of one dense information matrix; a larger factor is absorbed instead.
MAX_COLUMNS = 2_000


@dataclass(frozen=True)
class Categorical:
    """Treatment-coded levels; the first in sort order is the reference."""

    column: str


@dataclass(frozen=True)
class Numeric:
    column: str


@dataclass(frozen=True)
class NaturalSpline:
    """Natural cubic spline with inner knots; the outer knots are each model's range."""

    column: str
    knots: tuple[float, ...] = (4.0, 8.0)


Term = Categorical | Numeric | NaturalSpline


@dataclass(frozen=True)
class RateModel:
    """log(expected response / persons) = sum of terms."""

    response: str
    terms: tuple[Term, ...]
    family: str = NEGATIVE_BINOMIAL
    persons: str = "persons"

    @property
    def covariates(self) -> list[str]:
        return list(dict.fromkeys(t.column for t in self.terms))

    @property
    def splines(self) -> list[NaturalSpline]:
        return [t for t in self.terms if isinstance(t, NaturalSpline)]


def natural_spline(x: Column, low: Column, high: Column, knots: tuple[float, ...]) -> list[Column]:
    """Truncated-power basis of the natural cubic splines, without intercept.

    Linear beyond the outer knots ``low`` and ``high``; the variable is scaled
    to the unit interval first, which keeps the columns well conditioned.
    """
    span = high - low

    def unit(v: Column) -> Column:
        return F.try_divide(v - low, span)

    inner = [unit(F.lit(float(k))) for k in knots]
    points = [F.lit(0.0), *inner, F.lit(1.0)]
    u = unit(x)

    def cube(knot: Column) -> Column:
        over = F.greatest(u - knot, F.lit(0.0))
        return over * over * over

    def slope(knot: Column) -> Column:
        return (cube(knot) - cube(points[-1])) / (points[-1] - knot)

    last = slope(points[-2])
    return [u, *[slope(k) - last for k in points[:-2]]]


def check_spline(df: DataFrame, term: NaturalSpline) -> None:
    """Refuse a spline on a column that cannot carry one."""
    low, high = df.agg(F.min(term.column), F.max(term.column)).first()
    if low is None or not low < min(term.knots) or not max(term.knots) < high:
        raise ValueError(
            f"spline on {term.column} is not identified: knots {term.knots} need a wider range than {low} to {high}"
        )


def compress(df: DataFrame, model: RateModel, by: str | None = None) -> DataFrame:
    """Complete cases with people, as (model_id, covariates, n, y, f) rows."""
    group = F.col(by).cast("string") if by else F.lit("all")
    needed = [*model.covariates, model.persons, model.response] + ([by] if by else [])
    return (
        complete_cases(df, list(dict.fromkeys(needed)))
        .filter(F.col(model.persons) > 0)
        .groupBy(
            group.alias("model_id"),
            *model.covariates,
            F.col(model.persons).cast("double").alias("n"),
            F.col(model.response).cast("double").alias("y"),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("f"))
    )


def sum_events(rows: DataFrame, model: RateModel) -> DataFrame:
    """Rows with equal covariates summed: exact for Poisson coefficients."""
    return rows.groupBy("model_id", *model.covariates).agg(
        F.sum(F.col("f") * F.col("n")).alias("n"),
        F.sum(F.col("f") * F.col("y")).alias("y"),
    ).withColumn("f", F.lit(1.0))


@dataclass(frozen=True)
class Design:
    """A model with its levels known: names and expressions of its columns."""

    model: RateModel
    levels: dict[str, list]

    @cached_property
    def blocks(self) -> list[list[str]]:
        """Column names per term, in term order, without the intercept."""
        out = []
        for term in self.model.terms:
            if isinstance(term, Categorical):
                out.append([f"{term.column}{v:g}" if isinstance(v, float) else f"{term.column}{v}" for v in self.levels[term.column][1:]])
            elif isinstance(term, NaturalSpline):
                out.append([f"{term.column}_s{i + 1}" for i in range(len(term.knots) + 1)])
            else:
                out.append([term.column])
        return out

    @cached_property
    def names(self) -> list[str]:
        return [INTERCEPT, *[n for block in self.blocks for n in block]]

    @cached_property
    def bounds(self) -> list[str]:
        """Columns holding each spline's outer knots in a model."""
        return [f"{end}{i}" for i in range(len(self.model.splines)) for end in ("low", "high")]

    def _basis(self, term: NaturalSpline) -> list[Column]:
        i = self.model.splines.index(term)
        x = F.col(term.column).cast("double")
        return natural_spline(x, F.col(self.bounds[2 * i]), F.col(self.bounds[2 * i + 1]), term.knots)

    @cached_property
    def row(self) -> Column:
        """The design row as an array of doubles."""
        cells = [F.lit(1.0)]
        for term in self.model.terms:
            if isinstance(term, Categorical):
                for value in self.levels[term.column][1:]:
                    cells.append(F.when(F.col(term.column) == F.lit(value), 1.0).otherwise(0.0))
            elif isinstance(term, NaturalSpline):
                cells += self._basis(term)
            else:
                cells.append(F.col(term.column).cast("double"))
        return F.array(*cells)

    @cached_property
    def predictor(self) -> Column:
        """Linear predictor, without offset, from the coefficient array ``b``."""
        b, at = F.col("b"), 1
        parts = [b[0]]
        for term in self.model.terms:
            if isinstance(term, Categorical):
                values = self.levels[term.column][1:]
                if values:
                    picks = [(F.col(term.column) == F.lit(v), b[at + i]) for i, v in enumerate(values)]
                    chosen = reduce(lambda w, p: w.when(*p), picks[1:], F.when(*picks[0]))
                    parts.append(chosen.otherwise(0.0))
                at += len(values)
            elif isinstance(term, NaturalSpline):
                for column in self._basis(term):
                    parts.append(b[at] * column)
                    at += 1
            else:
                parts.append(b[at] * F.col(term.column).cast("double"))
                at += 1
        return reduce(lambda x, y: x + y, parts)


def find_levels(rows: DataFrame, model: RateModel) -> dict[str, list]:
    """Sorted levels of each categorical term, over all models together."""
    columns = [t.column for t in model.terms if isinstance(t, Categorical)]
    found: dict[str, list] = {c: [] for c in columns}
    if not columns:
        return found
    stacked = reduce(
        DataFrame.unionAll,
        [
            rows.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            .distinct()
            .limit(MAX_COLUMNS + 1)
            for c in columns
        ],
    )
    for r in stacked.collect():
        found[r["column"]].append(r["value"])
    for c in columns:
        if len(found[c]) > MAX_COLUMNS:
            raise ValueError(f"{c} has more than {MAX_COLUMNS} levels: let fit_absorbed take it as its factor")
        kind = rows.schema[c].dataType
        if isinstance(kind, NumericType):
            number = int if "." not in "".join(found[c]) and "E" not in "".join(found[c]) else float
            found[c] = sorted(number(v) for v in found[c])
        else:
            found[c] = sorted(found[c])
    return found
