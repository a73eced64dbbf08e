"""Models with one effect per level of a factor of any size.

The effects stay on the executors: a stored table has a row per level with its
effect and the sums of the last pass. A pass aggregates cells per level, and a
second, small aggregation adds up what the levels leave for the shared
coefficients (their Schur complement). The driver sees one p x p matrix and one
vector, however many levels there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratelab.functions.columns import normal_quantile
from ratelab.models.design import NEGATIVE_BINOMIAL, Design, RateModel, compress, find_levels
from ratelab.models.fit import (
    CONVERGED,
    LIKELIHOOD_TOLERANCE,
    NO_EVENTS,
    NO_OVERDISPERSION,
    STEP_LIMIT,
    STEP_TOLERANCE,
    THETA_LIMIT,
    UNBOUNDED,
    independent,
    next_theta,
    solve,
)
from ratelab.models.likelihood import Likelihood, series
from ratelab.scratch import Scratch

MAX_STEPS = 60


def given(df: DataFrame, **values) -> DataFrame:
    """``df`` with the same numbers, or arrays of numbers, on every row.

    They come from a table of one row and not as literals: the code that Spark
    generates then stays the same from step to step.
    """
    row = pa.table({k: pa.array([np.asarray(v, float).tolist()]) for k, v in values.items()})
    return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame(row)))


def numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def packed(p: int) -> list[tuple[int, int]]:
    """Places of the upper triangle, row by row; the first p are the first row."""
    return [(i, j) for i in range(p) for j in range(i, p)]


def square(values, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for (i, j), v in zip(packed(p), values):
        out[i, j] = out[j, i] = v
    return out


class LevelSums:
    """Passes of a likelihood that keep one stored row per level (``model_id``)."""

    def __init__(self, likelihood: Likelihood, scratch: Scratch, name: str):
        self.likelihood = likelihood
        self.design = likelihood.design
        self.p = len(likelihood.design.names)
        self.scratch = scratch
        self.name = name
        self.passes = 0

    def __call__(self, effects: DataFrame, b: np.ndarray, bounds: np.ndarray, theta: float = 1.0) -> DataFrame:
        """``effects`` (model_id, u) with the sums at coefficients ``b``, stored.

        ``info`` is the packed sum of x x' w; each of the likelihood's vectors
        is an array of that name after ``v_``; scalars have their own names.
        """
        like, design = self.likelihood, self.design
        constants = dict(zip(("lg_theta", "dg_theta", "tg_theta"), series(theta))) | {"theta": theta}
        constants |= dict(zip(design.bounds, bounds))
        # Only the intercept differs between levels.
        own = F.concat(F.array(F.col("coefficients")[0] + F.col("u")), F.slice("coefficients", 2, max(self.p - 1, 1)))
        table = given(effects, coefficients=b, **constants).select(
            "model_id", F.col("model_id").alias("fit_id"), own.alias("b"), *constants
        )
        sums = like.pattern_sums(table, full=True).withColumn("x", design.row)
        scalars = [c for c in like.full_sums if c not in ("sw", "sr")]
        triangle = ", ".join(f"sum(x[{i}] * x[{j}] * sw)" for i, j in packed(self.p))
        vectors = {v: ", ".join(f"sum(x[{i}] * {v})" for i in range(self.p)) for v in like.vectors}
        per_level = sums.groupBy(F.col("fit_id").alias("model_id")).agg(
            F.expr(f"array({triangle})").alias("info"),
            *[F.expr(f"array({v})").alias(f"v_{k}") for k, v in vectors.items()],
            *[F.sum(c).alias(c) for c in scalars],
        )
        self.passes += 1
        return self.scratch.keep(effects.select("model_id", "u").join(per_level, "model_id"), f"{self.name}{self.passes}")


def schur(p: int, own: str = "info[0]") -> str:
    """Packed information left for the coefficients once a level's effect, of curvature ``own``, follows them."""
    i, j = (", ".join(map(str, side)) for side in zip(*packed(p)))
    return f"transform(info, (v, k) -> v - coalesce(try_divide(info[array({i})[k]] * info[array({j})[k]], {own}), 0D))"


def summed(table: DataFrame, arrays: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and maxima over all rows, place by place, of some arrays put together."""
    values = table.select(F.expr(f"posexplode(concat({', '.join(arrays)}))").alias("pos", "value"))
    rows = values.groupBy("pos").agg(F.sum("value"), F.max("value")).collect()
    out = np.zeros((2, len(rows)))
    for r in rows:
        out[:, r[0]] = r[1:]
    return out[0], out[1]


# --- fixed effects ---------------------------------------------------------------------


@dataclass
class AbsorbedResult:
    """Coefficients beside one fixed effect per level; the effects are a stored table (level, effect, events)."""

    design: Design
    factor: str
    levels: int
    left_out: int
    cells: float
    b: np.ndarray
    free: np.ndarray
    covariance: np.ndarray
    theta: float | None
    loglik: float
    status: str
    effects: DataFrame


def spline_bounds(rows: DataFrame, model: RateModel) -> np.ndarray:
    """Outer knots of all splines, over all levels together, as the coefficients are shared."""
    ends = [f(t.column).cast("double") for t in model.splines for f in (F.min, F.max)]
    if not ends:
        return np.zeros(0)
    row = rows.agg(*ends).first()
    for i, term in enumerate(model.splines):
        low, high = row[2 * i], row[2 * i + 1]
        if low is None or not low < min(term.knots) or not max(term.knots) < high:
            raise ValueError(f"the spline is not identified on its range in the data: {term}")
    return np.array([float(v) for v in row])


def fit_absorbed(df: DataFrame, model: RateModel, factor: str, scratch: Scratch, max_steps: int = MAX_STEPS) -> AbsorbedResult:
    """Maximum likelihood with a fixed effect for every level of ``factor``, however many.

    The same coefficients, dispersion and likelihood as with ``factor`` among
    the categorical terms. A level's effect takes the place of the intercept.
    Levels without events have an effect of minus infinity and no bearing on
    anything else; they are counted in ``left_out``.
    """
    nb = model.family == NEGATIVE_BINOMIAL
    every = scratch.keep(compress(df, model, by=factor), "absorbed_all")
    totals = every.groupBy("model_id").agg(F.sum(F.col("f") * F.col("y")).alias("events"), F.sum(F.col("f") * F.col("n")).alias("people"), F.sum("f").alias("cells"))
    totals = scratch.keep(totals, "absorbed_levels")
    design = Design(model, find_levels(every, model))
    p = len(design.names)
    bounds = spline_bounds(every, model)
    count, cells = totals.agg(F.count(F.lit(1)), F.sum("cells")).first()
    if not count:
        raise ValueError("no complete cases with people to fit")
    some = totals.filter("events > 0")
    first = some.agg(F.count(F.lit(1)), F.sum("cells")).first()
    kept = first[0]
    nothing = AbsorbedResult(
        design, factor, kept, count - kept, float(cells), np.full(p, np.nan), np.zeros(p, dtype=bool), np.zeros((p, p)),
        None, math.nan, NO_EVENTS, some.select(F.col("model_id").alias("level"), F.lit(0.0).alias("effect"), "events"),
    )
    if not kept:
        return nothing
    sums = LevelSums(Likelihood(every, design, nb), scratch, "absorbed")
    effects = some.select("model_id", F.log(F.col("events") / F.col("people")).alias("u"))
    b, theta = np.zeros(p), 10.0
    best, merit, status = None, -math.inf, STEP_LIMIT
    names = ["ll", *(["dtheta", "ddtheta"] if nb else [])]
    arrays = [
        schur(p), "transform(v_sr, (s, i) -> s - coalesce(try_divide(info[i] * v_sr[0], info[0]), 0D))",
        f"array(abs(try_divide(v_sr[0], info[0])), info[0], {', '.join(names)})",
    ]
    for step in range(max_steps):
        at = sums(effects, b, bounds, theta)
        total, most = summed(at, arrays)
        size = p * (p + 1) // 2
        info, score = square(total[:size], p), total[size : size + p]
        furthest, weight, ll = most[size + p], total[size + p + 1], float(total[size + p + 2])
        gain = ll - merit
        if best is not None and not gain >= -1e-9 * (abs(ll) + 1):
            # Overshot: half the way, from where the last good step began.
            share /= 2
            effects, b, theta = _move(*best, move, share, goal)
            continue
        # Rounding leaves a trace of what each effect takes up.
        among = np.diag(info) > 1e-9 * max(weight, 1e-300)
        free = independent(info, among)
        best, merit = (at, b, theta), ll
        move, share = solve(info, score, free), 1.0
        goal = next_theta(theta, total[size + p + 3], total[size + p + 4]) if nb else theta
        pinned = nb and theta >= THETA_LIMIT * (1 - 1e-9) and total[size + p + 3] > 0
        goal = theta if pinned else goal
        moved = abs(math.log(goal / theta))
        shift = float(np.abs(move).max(initial=0))
        flat = step > 3 and moved < 1e-4 and gain < LIKELIHOOD_TOLERANCE * (abs(ll) + 1)
        if (max(shift, furthest) < STEP_TOLERANCE and moved < STEP_TOLERANCE) or flat:
            status = UNBOUNDED if shift > 0.1 else (NO_OVERDISPERSION if pinned else CONVERGED)
            break
        effects, b, theta = _move(*best, move, share, goal)
    covariance = np.zeros((p, p))
    at, b, theta = best
    covariance[np.ix_(free, free)] = np.linalg.pinv(info[np.ix_(free, free)])
    found = at.join(some.select("model_id", "events"), "model_id")
    found = found.select(F.col("model_id").alias("level"), F.col("u").alias("effect"), "events")
    return AbsorbedResult(
        design, factor, kept, count - kept, float(cells), b, free, covariance, theta if nb else None, merit, status, found,
    )


def _move(at: DataFrame, b: np.ndarray, theta: float, move: np.ndarray, share: float, goal: float):
    """Effects and coefficients a share of the joint step further on."""
    follow = " + ".join(f"info[{i}] * move[{i}]" for i in range(len(move)))
    step = F.expr(f"share * (v_sr[0] - ({follow})) / info[0]")
    effects = given(at, move=move, share=share).select("model_id", (F.col("u") + F.coalesce(step, F.lit(0.0))).alias("u"))
    return effects, b + share * move, theta * (goal / theta) ** share


def tidy_absorbed(fit: AbsorbedResult, spark: SparkSession, level: float = 0.95, exponentiate: bool = True) -> DataFrame:
    """One row per coefficient, without the intercept that the effects replace."""
    z = normal_quantile(level)
    out = []
    for j, name in enumerate(fit.design.names):
        if j == 0:
            continue
        if fit.status in (NO_EVENTS, STEP_LIMIT) or not fit.free[j]:
            out.append((name, *[None] * 6, fit.status))
            continue
        estimate, error = float(fit.b[j]), math.sqrt(fit.covariance[j, j])
        ends = [estimate, estimate - z * error, estimate + z * error]
        ends = [bounded_exp(v) for v in ends] if exponentiate else ends
        out.append((name, ends[0], error, estimate / error, math.erfc(abs(estimate / error) / math.sqrt(2)), *ends[1:], fit.status))
    return spark.createDataFrame(out, COEFFICIENTS)


COEFFICIENTS = (
    "term string, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double, status string"
)


def bounded_exp(value: float) -> float | None:
    """exp, or None where no double holds it."""
    return math.exp(value) if value < 700 else None
