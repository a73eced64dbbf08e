"""One pass over compressed cells: likelihood, score and information of many fits.

A pass first sums weights and residuals per covariate pattern, a handful of
sums per row, and only then forms products of design columns, over patterns
instead of rows. What reaches the driver is one small matrix per fit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ratelab.functions import special
from ratelab.models.design import Design

STATE = ["fit_id", "model_id", "b", "theta", "lg_theta", "dg_theta", "tg_theta"]


def series(theta: float) -> tuple[float, float, float]:
    """log-gamma, digamma and trigamma of a positive number."""
    z, product, one, two = theta + 8, 1.0, 0.0, 0.0
    for k in range(8):
        product *= theta + k
        one += 1 / (theta + k)
        two += 1 / ((theta + k) * (theta + k))
    r = 1 / z
    r2 = r * r
    dg = math.log(z) - r / 2 - r2 * (1 / 12 - r2 * (1 / 120 - r2 * (1 / 252 - r2 * (1 / 240 - r2 / 132)))) - one
    tg = r + r2 / 2 + r * r2 * (1 / 6 - r2 * (1 / 30 - r2 * (1 / 42 - r2 * (1 / 30 - r2 * 5 / 66)))) + two
    return math.lgamma(theta), dg, tg


@dataclass
class Stats:
    """Arrays over fits: sums of x x' w, of x times each vector weight, and of scalars."""

    info: np.ndarray
    vectors: dict[str, np.ndarray]
    scalars: dict[str, np.ndarray]

    @property
    def score(self) -> np.ndarray:
        return self.vectors["sr"]

    @property
    def ll(self) -> np.ndarray:
        return self.scalars["ll"]

    def spread(self, where: list[int], size: int) -> "Stats":
        """The same among ``size`` fits, zero for those not in ``where``."""

        def place(values: np.ndarray) -> np.ndarray:
            out = np.zeros((size, *values.shape[1:]))
            out[where] = values
            return out

        return Stats(
            place(self.info),
            {k: place(v) for k, v in self.vectors.items()},
            {k: place(v) for k, v in self.scalars.items()},
        )


class Likelihood:
    """Evaluates fits of one design over ``rows``, Poisson or negative binomial."""

    # Weights whose products with the design columns are summed.
    vectors = ["sr"]

    def __init__(self, rows: DataFrame, design: Design, negative_binomial: bool):
        self.rows = rows
        self.design = design
        self.nb = negative_binomial

    def __call__(
        self,
        models: list[str],
        b: np.ndarray,
        bounds: np.ndarray,
        theta: np.ndarray | None = None,
        full: bool = False,
    ) -> Stats:
        """One Spark job. ``full`` adds deviance, Pearson sum and the constant of the likelihood."""
        fits, p = b.shape
        shape = [float(t) for t in theta] if self.nb else [1.0] * fits
        values = [series(t) for t in shape]
        state = pa.Table.from_arrays(
            [
                pa.array(range(fits), pa.int64()),
                pa.array(models, pa.string()),
                pa.array(b.tolist(), pa.list_(pa.float64())),
                pa.array(shape, pa.float64()),
                *[pa.array([s[k] for s in values], pa.float64()) for k in range(3)],
                *[pa.array(column, pa.float64()) for column in bounds.T],
            ],
            names=STATE + self.design.bounds,
        )
        # At most as many rows as fits in the slice, a size checked by the caller.
        table = F.broadcast(self.rows.sparkSession.createDataFrame(state))
        scalars = [c for c in (self.full_sums if full else self._sums) if c not in ("sw", "sr")]
        products = self._products(self.pattern_sums(table, full), scalars, p)
        return self._unpack(products.toArrow(), scalars, fits, p)

    @cached_property
    def _sums(self) -> dict[str, Column]:
        """Sums every pass needs, over ``y``, ``eta``, ``mu`` and the fit's ``theta``."""
        if self.nb:
            sums = {
                "sw": F.expr("mu * theta / (mu + theta)"),
                "sr": F.expr("(y - mu) * theta / (mu + theta)"),
                "ll": special.log_gamma("y + theta")
                + F.expr("y * (eta - ln(mu + theta)) - theta * log1p(mu / theta) - lg_theta"),
                "dtheta": special.digamma("y + theta")
                + F.expr("(mu - y) / (mu + theta) - log1p(mu / theta) - dg_theta"),
                "ddtheta": special.trigamma("y + theta")
                + F.expr(
                    "mu / (theta * (mu + theta)) - (mu - y) / ((mu + theta) * (mu + theta)) - tg_theta"
                ),
            }
        else:
            sums = {"sw": F.col("mu"), "sr": F.expr("y - mu"), "ll": F.expr("y * eta - mu")}
            sums["excess"] = F.expr("(y - mu) * (y - mu) - mu")
            sums["mu2"] = F.expr("mu * mu")
        return sums

    @cached_property
    def full_sums(self) -> dict[str, Column]:
        """The same with the likelihood's constant, Pearson sum and deviance."""
        variance = "mu * (1 + mu / theta)" if self.nb else "mu"
        gap = "(y + theta) * ln((y + theta) / (mu + theta))" if self.nb else "y - mu"
        return {
            **self._sums,
            "ll": self._sums["ll"] - special.log_gamma("y + 1D"),
            "pearson": F.expr(f"(y - mu) * (y - mu) / ({variance})"),
            "deviance": F.expr(f"2 * (CASE WHEN y > 0 THEN y * (ln(y) - ln(mu)) ELSE 0D END - ({gap}))"),
        }

    def pattern_sums(self, table: DataFrame, full: bool) -> DataFrame:
        df = (
            self.rows.join(table, "model_id")
            .withColumn("eta", self.design.predictor + F.log("n"))
            .withColumn("mu", F.exp(F.least("eta", F.lit(700.0))))
        )
        sums = self.full_sums if full else self._sums
        return df.groupBy("fit_id", *self.design.model.covariates).agg(
            *[F.sum(F.col("f") * value).alias(name) for name, value in sums.items()],
            *[F.any_value(name).alias(name) for name in self.design.bounds],
        )

    def _products(self, sums: DataFrame, scalars: list[str], p: int) -> DataFrame:
        # Positions hold the upper triangle of x x' sw, then x times each vector
        # weight, then the scalar sums. Only columns that are not zero in the
        # pattern give rows, so indicator columns cost little.
        upper = p * (p + 1) // 2
        after = upper + p * len(self.vectors)
        matrix = f"""flatten(transform(at, i -> transform(filter(at, j -> j >= i), j ->
            struct(i * {p} - i * (i - 1) div 2 + j - i AS pos, x[CAST(i AS INT)] * x[CAST(j AS INT)] * sw AS value))))"""
        vectors = [
            f"transform(at, i -> struct({upper + p * k} + i AS pos, x[CAST(i AS INT)] * {name} AS value))"
            for k, name in enumerate(self.vectors)
        ]
        single = ", ".join(f"struct({after + k}L AS pos, {name} AS value)" for k, name in enumerate(scalars))
        return (
            sums.withColumn("x", self.design.row)
            .withColumn("at", F.expr(f"filter(sequence(0L, {p - 1}L), i -> x[CAST(i AS INT)] != 0)"))
            .select("fit_id", F.expr(f"inline(concat({matrix}, {', '.join(vectors)}, array({single})))"))
            .groupBy("fit_id", "pos")
            .agg(F.sum("value").alias("value"))
        )

    def _unpack(self, result: pa.Table, scalars: list[str], fits: int, p: int) -> Stats:
        upper = p * (p + 1) // 2
        after = upper + p * len(self.vectors)
        flat = np.zeros((fits, after + len(scalars)))
        flat[result["fit_id"].to_numpy(), result["pos"].to_numpy()] = result["value"].to_numpy()
        info = np.zeros((fits, p, p))
        rows, cols = np.triu_indices(p)
        info[:, rows, cols] = flat[:, :upper]
        info[:, cols, rows] = flat[:, :upper]
        vectors = {v: flat[:, upper + p * i : upper + p * (i + 1)] for i, v in enumerate(self.vectors)}
        return Stats(info, vectors, {name: flat[:, after + i] for i, name in enumerate(scalars)})


class Curvature(Likelihood):
    """Adds what integrating out an intercept needs: observed curvature and its slopes."""

    vectors = ["sr", "curve", "third"]

    @cached_property
    def _sums(self) -> dict[str, Column]:
        sums = dict(super()._sums)
        if self.nb:
            sums["curve"] = F.expr("mu * theta * (theta + y) / ((theta + mu) * (theta + mu))")
            sums["third"] = F.expr("theta * (theta + y) * mu * (theta - mu) / power(theta + mu, 3)")
            sums["curve_t"] = F.expr("mu * (2 * theta * mu + y * mu - y * theta) / power(theta + mu, 3)")
            sums["score_t"] = F.expr("(y - mu) * mu / ((theta + mu) * (theta + mu))")
        else:
            sums["curve"] = sums["third"] = F.col("mu")
        return sums


class Moments(Likelihood):
    """Sums of squares and products of log-scale residuals for a linear model."""

    @cached_property
    def _sums(self) -> dict[str, Column]:
        return {"sw": F.lit(1.0), "sr": F.expr("y - ln(n)"), "ll": F.expr("(y - ln(n)) * (y - ln(n))")}

    @property
    def full_sums(self) -> dict[str, Column]:
        return self._sums
