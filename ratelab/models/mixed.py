"""Rate models with a random intercept per group.

Given the group intercepts, a pass is the ordinary likelihood pass with one
fit per group, its intercept shifted. The marginal likelihood is Laplace's
approximation; coefficients, spread and dispersion move together along its
exact gradient, scaled by approximate information.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratelab.functions.columns import normal_quantile
from ratelab.models.design import NEGATIVE_BINOMIAL, Design, RateModel, compress, find_levels
from ratelab.models.fit import NO_EVENTS, STEP_LIMIT, independent
from ratelab.models.levels import LevelSums, bounded_exp, given, numbers, packed, schur, spline_bounds, square, summed
from ratelab.models.likelihood import Curvature, Moments
from ratelab.scratch import Scratch

MAX_STEPS = 60
HALVINGS = 8
OVERSHOT = 0.02
TOLERANCE = 1e-7
SPREAD_LIMIT = 1e-4
THETA_LIMIT = 1e5
GAUSSIAN = "gaussian"
RATIOS = (-20.0, 10.0)  # log(variance of intercepts / residual variance)
RATIO_TOLERANCE = 1e-9

MIXED_SUMMARY = (
    "family string, groups long, n long, spread double, theta double, residual double, "
    "pearson_ratio double, loglik double, aic double, status string"
)


@dataclass
class MixedResult:
    """Shared numbers on the driver; ``intercepts`` is a stored table (level, intercept)."""

    design: Design
    family: str
    groups: int
    cells: float
    b: np.ndarray
    covariance: np.ndarray
    free: np.ndarray
    intercepts: DataFrame
    spread: float
    theta: float | None
    residual: float | None
    pearson: float | None
    loglik: float
    status: str

    @property
    def usable(self) -> bool:
        return self.status not in (NO_EVENTS, STEP_LIMIT)


def fit_random_intercept(df: DataFrame, model: RateModel, group: str, scratch: Scratch) -> MixedResult:
    """Maximum (Laplace) likelihood with a normal intercept per value of ``group``, however many.

    The intercepts stay in a stored table, one row per group, that each step
    replaces; sums over all groups are all that reaches the driver.
    """
    rows = scratch.keep(compress(df, model, by=group), "mixed_rows")
    design = Design(model, find_levels(rows, model))
    bounds = spline_bounds(rows, model)
    p = len(design.names)
    f, y, n = F.col("f"), F.col("y"), F.col("n")
    cells, events, people, groups = rows.agg(F.sum("f"), F.sum(f * y), F.sum(f * n), F.count_distinct("model_id")).first()
    if not groups:
        raise ValueError("no complete cases with people to fit")
    effects = rows.select("model_id").distinct().withColumn("u", F.lit(0.0))
    if model.family == GAUSSIAN:
        return _fit_gaussian(rows, design, bounds, effects, groups, cells, scratch)
    if not events:
        return MixedResult(
            design, model.family, groups, cells, np.full(p, np.nan), np.zeros((p, p)), np.zeros(p, dtype=bool),
            _named(effects.withColumn("u", F.lit(None).cast("double"))), math.nan, None, None, None, math.nan, NO_EVENTS,
        )
    nb = model.family == NEGATIVE_BINOMIAL
    sums = LevelSums(Curvature(rows, design, nb), scratch, "mixed")
    b = np.zeros(p)
    b[0] = math.log(events / people)
    spread, theta, free = 0.5, 10.0, None
    best: _Point | None = None
    halvings, share = 0, 1.0
    status = STEP_LIMIT
    for _ in range(MAX_STEPS):
        table = sums(effects, b, bounds, theta)
        point = _totals(table, b, spread, theta, p, nb)
        # The value is approximate away from the maximum, so only a clear fall
        # (or no number) means that the step went too far.
        if best is not None and not point.value >= best.value - OVERSHOT * (1 + abs(best.value)) and halvings < HALVINGS:
            halvings, share = halvings + 1, share / 2
        else:
            if free is None:
                free = independent(point.total)
            best, halvings = point, 0
            step = _step(point, free, nb)
            share = min(1.0, 2 / step.size) if step.size > 0 else 1.0
            if step.size < TOLERANCE:
                status = "no_spread" if step.at_edge else "converged"
                break
        effects = _follow(best, step, share)
        b = best.b + share * step.b
        spread = max(best.spread * math.exp(share * step.spread), SPREAD_LIMIT)
        theta = min(best.theta * math.exp(share * step.theta), THETA_LIMIT)
    covariance = np.zeros((p, p))
    part = np.ix_(free, free)
    covariance[part] = np.linalg.inv(best.info[part])
    left = cells - int(free.sum()) - 1 - nb
    return MixedResult(
        design, model.family, groups, cells, best.b, covariance, free, _named(best.table), best.spread,
        best.theta if nb else None, None, float(best.sums["pearson"] / left) if left > 0 else None, best.sums["value"], status,
    )


def _named(effects: DataFrame) -> DataFrame:
    return effects.select(F.col("model_id").alias("level"), F.col("u").alias("intercept"))


@dataclass
class _Point:
    """A pass over all groups: where it was taken, its stored table, and sums over groups."""

    table: DataFrame
    b: np.ndarray
    spread: float
    theta: float
    info: np.ndarray  # left for the coefficients
    total: np.ndarray  # sum of x x' w
    gradient: np.ndarray
    sums: dict[str, float]

    @property
    def value(self) -> float:
        """The likelihood at the modes, to second order."""
        return self.sums["value"] + self.sums["gain"] / 2


@dataclass
class _Step:
    b: np.ndarray
    spread: float
    theta: float
    size: float
    at_edge: bool


def _per_group(table: DataFrame, spread: float, **more) -> DataFrame:
    """The groups' rows with what the modes they are moving to say of each."""
    table = given(table, inverse=1 / spread**2, **more)
    table = table.withColumns({"own": F.expr("curve + inverse"), "pull": F.expr("v_sr[0] - u * inverse")})
    table = table.withColumn("to_mode", F.expr("pull / own"))
    # du_spread: how a mode follows log(spread).
    table = table.withColumns({"mode": F.expr("u + to_mode"), "shrink": F.expr("curve / own")})
    return table.withColumn("du_spread", F.expr("2 * mode * inverse / own"))


def _totals(table: DataFrame, b: np.ndarray, spread: float, theta: float, p: int, nb: bool) -> _Point:
    """Sums over groups of the likelihood and its gradients, at the modes the intercepts are moving to."""
    named = {
        "value": "ll - u * u * inverse / 2 - ln(own / inverse) / 2",
        "gain": "pull * to_mode",
        "spread": "mode * mode * inverse - shrink - third * du_spread / own / 2",
        "shrink2": "shrink * shrink",
        "pearson": "pearson",
        "furthest": "abs(to_mode)",
    }
    if nb:
        named["theta1"] = "dtheta + score_t * to_mode - (curve_t + third * score_t / own) / own / 2"
        named["theta2"] = "ddtheta"
    gradient = "transform(v_sr, (s, i) -> s - v_curve[i] * to_mode - (v_third[i] - third * v_curve[i] / own) / own / 2)"
    total, most = summed(
        _per_group(table, spread), [schur(p, "(info[0] + inverse)"), "info", gradient, f"array({', '.join(named.values())})"]
    )
    size = p * (p + 1) // 2
    at = 2 * size + p
    sums = {k: float(v) for k, v in zip(named, total[at:])}
    sums["furthest"] = float(most[at + list(named).index("furthest")])
    return _Point(
        table, b, spread, theta, square(total[:size], p), square(total[size : 2 * size], p), total[2 * size : at], sums
    )


def _step(at: _Point, free: np.ndarray, nb: bool) -> _Step:
    b = np.zeros(len(free))
    b[free] = np.linalg.solve(at.info[np.ix_(free, free)], at.gradient[free])
    s = at.sums
    at_edge = at.spread <= SPREAD_LIMIT and s["spread"] < 0
    spread = 0.0 if at_edge else float(np.clip(s["spread"] / max(2 * s["shrink2"], 1e-12), -2, 1))
    theta = 0.0
    if nb:
        g = at.theta * s["theta1"]
        h = at.theta**2 * s["theta2"] + g
        theta = float(np.clip(-g / h if h < 0 else np.sign(g), -1, 1))
        if at.theta >= THETA_LIMIT and theta > 0:
            theta = 0.0
    # Coefficients count by the mean change of the predictor: columns may be
    # large or nearly combinations of each other.
    shift = math.sqrt(max(b @ at.total @ b / at.total[0, 0], 0.0))
    return _Step(b, spread, theta, max(shift, s["furthest"], abs(spread), abs(theta)), at_edge)


def _follow(at: _Point, step: _Step, share: float) -> DataFrame:
    """Intercepts a share of the step on: to their modes, and after coefficients and spread."""
    after = " + ".join(f"v_curve[{i}] * move[{i}]" for i in range(len(step.b)))
    table = _per_group(at.table, at.spread, move=step.b, widen=step.spread, share=share)
    return table.select("model_id", F.expr(f"u + share * (to_mode - ({after}) / own + du_spread * widen)").alias("u"))


# --- Gaussian ----------------------------------------------------------------------------


def _fit_gaussian(
    rows: DataFrame, design: Design, bounds: np.ndarray, effects: DataFrame, groups: int, cells: float, scratch: Scratch
) -> MixedResult:
    """Identity link, offset log(persons): one pass over cells, then a search over the ratio of variances.

    The likelihood needs a group's sums only, weighted by its number of cells;
    groups with equally many cells are added up first.
    """
    p = len(design.names)
    table = LevelSums(Moments(rows, design, False), scratch, "moments")(effects, np.zeros(p), bounds)
    info, z = F.col("info"), F.col("v_sr")
    places = packed(p)
    size = len(places)
    by_size = table.groupBy(info[0].alias("k")).agg(
        F.count(F.lit(1)).alias("groups"),
        F.array(*[F.sum(info[i] * info[j]) for i, j in places]).alias("xx"),
        F.array(*[F.sum(info[i] * z[0]) for i in range(p)]).alias("xz"),
        F.sum(z[0] * z[0]).alias("zz"),
    )
    by_size = scratch.keep(by_size, "moments_by_size")
    row = table.agg(*[F.sum(info[k]) for k in range(size)], *[F.sum(z[i]) for i in range(p)], F.sum("ll")).first()
    whole, right, square_sum = square(row[:size], p), np.array(row[size : size + p]), row[size + p]
    free = independent(whole)
    part = np.ix_(free, free)

    def at(ratios: list[float]) -> list[tuple[float, float, np.ndarray, float, np.ndarray, float]]:
        """Log likelihood and its slope by log(ratio), coefficients, variance and information, and the Pearson sum."""
        # Inverse of I + ratio 11' within each group.
        tried = by_size.withColumn("ratio", F.explode(numbers(ratios)))
        one = 1 + F.col("ratio") * F.col("k")
        c, d = F.col("ratio") / one, 1 / (one * one)
        weights = [c, d, c * c * F.col("k")]
        sums = tried.groupBy("ratio").agg(
            F.sum(F.col("groups") * F.log(one)), F.sum(F.col("groups") * F.col("k") / one),
            *[F.sum(w * F.col("xx")[k]) for w in weights for k in range(size)],
            *[F.sum(w * F.col("xz")[i]) for w in weights for i in range(p)],
            *[F.sum(w * F.col("zz")) for w in weights],
        )
        found = {r[0]: r[1:] for r in sums.collect()}
        out = []
        for ratio in ratios:
            v = found[ratio]
            m = [square(v[2 + k * size : 2 + (k + 1) * size], p) for k in range(3)]
            start = 2 + 3 * size
            r = [np.array(v[start + k * p : start + (k + 1) * p]) for k in range(3)]
            q = v[start + 3 * p :]
            a, left = whole - m[0], right - r[0]
            beta = np.zeros(p)
            beta[free] = np.linalg.solve(a[part], left[free])
            rss = square_sum - q[0] - beta @ left
            variance = rss / cells
            ll = -0.5 * (cells * (math.log(2 * math.pi * variance) + 1) + v[0])
            # Squared residual sums of groups, under each weight.
            e = [q[k] - 2 * beta @ r[k] + beta @ m[k] @ beta for k in range(3)]
            slope = 0.5 * ratio * (e[1] / variance - v[1])
            inside = square_sum - 2 * beta @ right + beta @ whole @ beta
            out.append((ll, slope, beta, variance, a, inside - 2 * e[0] + e[2]))
        return out

    low, high = RATIOS
    tried = np.linspace(low, high, 31).tolist()
    best = int(np.argmax([x[0] for x in at([math.exp(v) for v in tried])]))
    low, high = tried[max(best - 1, 0)], tried[min(best + 1, 30)]
    while high - low > RATIO_TOLERANCE:
        inner = np.linspace(low, high, 18)[1:-1].tolist()
        slopes = [x[1] for x in at([math.exp(v) for v in inner])]
        rising = sum(s > 0 for s in slopes)
        ends = [low, *inner, high]
        low, high = ends[rising], ends[rising + 1]
    ratio = math.exp((low + high) / 2)
    none, found = at([0.0, ratio])
    edge = none[0] >= found[0]
    ratio = 0.0 if edge else ratio
    ll, _, b, variance, a, pearson = none if edge else found
    covariance = np.zeros((p, p))
    covariance[part] = np.linalg.inv(a[part]) * variance
    left = cells - int(free.sum()) - 2
    # A group's residual sum, shrunk.
    apart = z[0] - sum((info[i] * F.lit(float(v)) for i, v in enumerate(b)), F.lit(0.0))
    effects = table.select("model_id", (F.lit(ratio) / (1 + F.lit(ratio) * info[0]) * apart).alias("u"))
    return MixedResult(
        design, GAUSSIAN, groups, float(cells), b, covariance, free, _named(effects), math.sqrt(ratio * variance), None,
        math.sqrt(variance), float(pearson / left) if left > 0 else None, ll, "no_spread" if edge else "converged",
    )


def mixed_parameters(fit: MixedResult) -> int:
    extra = {GAUSSIAN: 2, NEGATIVE_BINOMIAL: 2}.get(fit.family, 1)
    return int(fit.free.sum()) + extra


def mixed_aic(fit: MixedResult) -> float:
    return -2 * fit.loglik + 2 * mixed_parameters(fit)


def tidy_mixed(
    fit: MixedResult, spark: SparkSession, level: float = 0.95, exponentiate: bool = True
) -> DataFrame:
    """Fixed effects with Wald limits; nulls, and why on every row, if the fit did not settle."""
    z = normal_quantile(level)
    scale = bounded_exp if exponentiate and fit.family != GAUSSIAN else float
    out = []
    for j, name in enumerate(fit.design.names):
        if not fit.usable or not fit.free[j]:
            out.append((name, *[None] * 6, fit.status))
            continue
        error = math.sqrt(fit.covariance[j, j])
        statistic = fit.b[j] / error
        p = math.erfc(abs(statistic) / math.sqrt(2))
        ends = [scale(fit.b[j] + side * z * error) for side in (-1, 1)]
        out.append((name, scale(fit.b[j]), error, float(statistic), p, *ends, fit.status))
    columns = ["estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"]
    return spark.createDataFrame(out, "term string, " + ", ".join(f"{c} double" for c in columns) + ", status string")


def summary_mixed(fit: MixedResult, spark: SparkSession) -> DataFrame:
    if not fit.usable:
        row = (fit.family, fit.groups, int(fit.cells), *[None] * 6, fit.status)
        return spark.createDataFrame([row], MIXED_SUMMARY)
    row = (
        fit.family, fit.groups, int(fit.cells), fit.spread, fit.theta, fit.residual,
        fit.pearson, fit.loglik, mixed_aic(fit), fit.status,
    )
    return spark.createDataFrame([row], MIXED_SUMMARY)
