"""Coefficient tables, limits, fit summaries and model comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratelab.functions.columns import normal_quantile
from ratelab.models.design import INTERCEPT, NEGATIVE_BINOMIAL
from ratelab.models.fit import DRIVER_ENTRIES, NO_OVERDISPERSION, STEP_LIMIT, UNBOUNDED, FitResult, maximise, solve
from ratelab.models.mixed import MixedResult, mixed_aic, mixed_parameters

COEFFICIENTS = (
    "model_id string, term string, estimate double, std_error double, statistic double, "
    "p_value double, conf_low double, conf_high double, status string"
)
SUMMARY = (
    "model_id string, family string, n long, df_residual long, theta double, se_theta double, "
    "deviance double, pearson_ratio double, loglik double, aic double, status string"
)
DEVIANCE = (
    "model_id string, term string, df long, deviance double, df_residual long, "
    "residual_deviance double, p_value double"
)


def _number(value: float) -> float | None:
    return float(value) if np.isfinite(value) else None


def settled(fit: FitResult) -> list[int]:
    """Models whose coefficients are the maximum's."""
    return [i for i in fit.usable if fit.status[i] not in (STEP_LIMIT, UNBOUNDED)]


def _batches(items: list, columns: int) -> list[list]:
    """Parts of ``items`` whose matrices the driver can hold together."""
    size = max(1, DRIVER_ENTRIES // columns**2)
    return [items[at : at + size] for at in range(0, len(items), size)]


def tidy(
    fit: FitResult,
    spark: SparkSession,
    level: float = 0.95,
    exponentiate: bool = True,
    method: str = "wald",
    terms: Sequence[str] | None = None,
) -> DataFrame:
    """One row per coefficient. Exponentiating leaves the standard error alone.

    A batch of labelled variants gets an ``adjustment`` column.
    ``method`` is "wald" or "profile". A term that is a combination of earlier
    ones has nulls; so have all terms of a model that could not be fitted, did
    not settle or runs off, as ``status`` says on every row.
    """
    z = normal_quantile(level)
    names = fit.design.names
    wanted = [j for j, name in enumerate(names) if terms is None or name in terms]
    scale = math.exp if exponentiate else float
    limits = profile_limits(fit, wanted, level) if method == "profile" else {}
    out = []
    for i, model_id in enumerate(fit.models):
        usable = i in settled(fit)
        for j in wanted:
            if not fit.used[i, j]:
                continue
            if not usable or not fit.free[i, j]:
                out.append((model_id, names[j], *[None] * 6, fit.status[i], fit.labels[i]))
                continue
            estimate = fit.b[i, j]
            error = math.sqrt(max(fit.covariance[i, j, j], 0.0))
            statistic = estimate / error if error > 0 else math.nan
            low, high = limits.get((i, j), (estimate - z * error, estimate + z * error))
            ends = [_number(scale(v)) if np.isfinite(v) and v < 700 else None for v in (low, high)]
            out.append(
                (
                    model_id,
                    names[j],
                    _number(scale(estimate)) if estimate < 700 else None,
                    error,
                    _number(statistic),
                    _number(math.erfc(abs(statistic) / math.sqrt(2))),
                    *ends,
                    fit.status[i],
                    fit.labels[i],
                )
            )
    table = spark.createDataFrame(out, COEFFICIENTS + ", adjustment string")
    return table if any(fit.labels) else table.drop("adjustment")


def profile_limits(
    fit: FitResult, columns: Sequence[int], level: float = 0.95, max_steps: int = 30
) -> dict[tuple[int, int], tuple[float, float]]:
    """Profile likelihood limits, dispersion held at its estimate.

    Each limit solves "likelihood = maximum - z^2/2, other scores = 0" by the
    steps of Venzon and Moolgavkar (1988). Limits of all models share the
    Spark passes, as separate fits of a batch; the driver's budget bounds it.
    """
    tasks = [
        (i, j, side) for i in settled(fit) for j in columns if fit.free[i, j] for side in (-1.0, 1.0)
    ]
    ends: dict[tuple[int, int], list[float]] = {}
    for batch in _batches(tasks, len(fit.design.names)):
        for (i, j, _), end in zip(batch, _profile_ends(fit, batch, level, max_steps)):
            ends.setdefault((i, j), []).append(end)
    return {key: (pair[0], pair[1]) for key, pair in ends.items()}


def _profile_ends(fit: FitResult, tasks: list[tuple[int, int, float]], level: float, max_steps: int) -> list[float]:
    """The limit of each (model, column, side); nan where it does not settle."""
    half = normal_quantile(level) ** 2 / 2
    who = [t[0] for t in tasks]
    models = [fit.models[i] for i in who]
    bounds, theta = fit.bounds[who], fit.theta[who]
    plain = fit.likelihood(models, fit.b[who], bounds, theta)
    target = plain.ll - half
    b = fit.b[who].copy()
    for k, (i, j, side) in enumerate(tasks):
        column = fit.covariance[i][:, j]
        b[k] += side * math.sqrt(2 * half) * column / math.sqrt(column[j])
    done = np.zeros(len(tasks), dtype=bool)
    for _ in range(max_steps):
        active = np.flatnonzero(~done)
        if not len(active):
            break
        s = fit.likelihood([models[k] for k in active], b[active], bounds[active], theta[active])
        for a, k in enumerate(active):
            i, j, side = tasks[k]
            free = fit.free[i]
            unit = np.zeros(len(free))
            unit[j] = 1.0
            v = solve(s.info[a], unit, free)
            u = solve(s.info[a], s.score[a], free)
            square = 2 * (s.ll[a] - target[k] + s.score[a] @ u / 2) / v[j] if v[j] > 0 else -1.0
            if not square >= 0:
                b[k] = (b[k] + fit.b[i]) / 2
                continue
            step = u + side * math.sqrt(square) * v
            # As the mean change of the predictor, whatever the scale of columns.
            size = math.sqrt(max(step @ s.info[a] @ step / s.info[a][0, 0], 0.0))
            b[k] += step if size <= 2 else step * (2 / size)
            done[k] = size < 1e-7
    return [b[k][j] if done[k] else math.nan for k, (_, j, _) in enumerate(tasks)]


def rank(fit: FitResult) -> np.ndarray:
    return fit.free.sum(axis=1)


def aic(fit: FitResult) -> np.ndarray:
    """-2 loglik + 2 k; the dispersion counts as a parameter."""
    return -2 * fit.stats.ll + 2 * (rank(fit) + (fit.family == NEGATIVE_BINOMIAL))


def summary(fit: FitResult, spark: SparkSession) -> DataFrame:
    """One row per model. ``pearson_ratio`` is the overdispersion ratio."""
    out = []
    nb = fit.family == NEGATIVE_BINOMIAL
    for i, model_id in enumerate(fit.models):
        if i not in fit.usable:
            out.append((model_id, fit.family, *[None] * 8, fit.status[i]))
            continue
        s = {k: v[i] for k, v in fit.stats.scalars.items()}
        left = int(fit.cells[i]) - int(rank(fit)[i])
        theta = float(fit.theta[i]) if nb else None
        known = nb and fit.status[i] != NO_OVERDISPERSION and s["ddtheta"] < 0
        se = 1 / math.sqrt(-s["ddtheta"]) if known else None
        out.append(
            (
                model_id, fit.family, int(fit.cells[i]), left, theta, se, float(s["deviance"]),
                float(s["pearson"] / left) if left > 0 else None, float(s["ll"]),
                float(aic(fit)[i]), fit.status[i],
            )
        )
    return spark.createDataFrame(out, SUMMARY)


def compare_aic(fits: dict[str, FitResult | MixedResult], spark: SparkSession) -> DataFrame:
    """AIC of several models of the same response, one row per model and group.

    Models with a random intercept stand beside plain ones with their
    approximate marginal likelihood; their spread counts as a parameter.
    """
    responses = {f.design.model.response for f in fits.values()}
    if len(responses) > 1:
        raise ValueError(f"AIC compares models of one response, not of {sorted(responses)}")
    out = []
    for name, f in fits.items():
        if isinstance(f, MixedResult):
            if f.usable:
                out.append((name, "all", mixed_parameters(f), float(f.loglik), mixed_aic(f)))
            continue
        values, k = aic(f), rank(f) + (f.family == NEGATIVE_BINOMIAL)
        out += [(name, f.models[i], int(k[i]), float(f.stats.ll[i]), float(values[i])) for i in f.usable]
    return spark.createDataFrame(out, "model string, model_id string, df long, loglik double, aic double")


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by its finite series."""
    if df <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2:
        total, term, k = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / math.gamma(1.5), 1.5
    else:
        total, term, k = math.exp(-h), math.exp(-h) * h, 2.0
    while k <= df / 2:
        total += term
        term *= h / k
        k += 1
    return min(total, 1.0)


def sequential_deviance(fit: FitResult, spark: SparkSession) -> DataFrame:
    """Deviance as terms are added in order, dispersion held at the full fit.

    All nested models of all groups are fitted in one batch, each as the full
    design with the later columns fixed at zero.
    """
    design = fit.design
    ends = np.cumsum([1] + [len(block) for block in design.blocks])
    labels = ["NULL", *[t.column for t in design.model.terms]]
    who, masks = [], []
    for i in fit.usable:
        for end in ends:
            mask = fit.free[i].copy()
            mask[end:] = False
            who.append(i)
            masks.append(mask)
    if not who:
        return spark.createDataFrame([], DEVIANCE)
    free = np.array(masks)
    deviance = np.zeros(len(who))
    for batch in _batches(list(range(len(who))), len(design.names)):
        own = [who[k] for k in batch]
        models = [fit.models[i] for i in own]
        start = np.where(free[batch], fit.b[own], 0.0)
        start[:, 1:] = 0.0
        bounds, theta = fit.bounds[own], fit.theta[own]
        nested = maximise(fit.likelihood, models, start, bounds, free[batch], theta=theta)
        deviance[batch] = fit.likelihood(models, nested.b, bounds, theta, full=True).scalars["deviance"]
    out, k = [], 0
    for i in fit.usable:
        for t, label in enumerate(labels):
            used = int(free[k].sum())
            left = int(fit.cells[i]) - used
            if t == 0:
                out.append((fit.models[i], label, None, None, left, float(deviance[k]), None))
            else:
                df = used - int(free[k - 1].sum())
                drop = float(deviance[k - 1] - deviance[k])
                p = chi_square_tail(drop, df) if df else None
                out.append((fit.models[i], label, df, drop, left, float(deviance[k]), p))
            k += 1
    return spark.createDataFrame(out, DEVIANCE)


def scores(fit: FitResult, spark: SparkSession) -> DataFrame:
    """Score of each coefficient at the fit, relative to its root information."""
    out = []
    for i in fit.usable:
        for j, name in enumerate(fit.design.names):
            if fit.free[i, j]:
                size = math.sqrt(fit.stats.info[i, j, j])
                out.append((fit.models[i], name, float(fit.stats.score[i, j] / size)))
    return spark.createDataFrame(out, "model_id string, term string, score double")


def keep_term(table: DataFrame, term: str) -> DataFrame:
    return table.filter(F.col("term") == term)


def forest_table(table: DataFrame) -> DataFrame:
    """Estimates and limits of all terms but the intercept, for plotting."""
    return table.filter(F.col("term") != INTERCEPT).select(
        *[c for c in ("model_id", "adjustment") if c in table.columns],
        "term", "estimate", "conf_low", "conf_high",
    )
