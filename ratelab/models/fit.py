"""Maximum likelihood for many rate models at once.

All models of a batch advance together: one Spark job per step, one small
solve per model. Coefficients and dispersion step jointly, which is safe
because their information is block diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ratelab.models.design import (
    NEGATIVE_BINOMIAL,
    POISSON,
    Design,
    RateModel,
    Term,
    compress,
    find_levels,
    sum_events,
)
from ratelab.models.likelihood import Likelihood, Stats
from ratelab.scratch import Scratch

MAX_STEPS = 50
STEP_TOLERANCE = 1e-7
LIKELIHOOD_TOLERANCE = 1e-12
THETA_LIMIT = 1e5
# Matrix entries held on the driver at a time (8 bytes each). Batches with
# more models are fitted in slices.
DRIVER_ENTRIES = 4_000_000

CONVERGED = "converged"
STEP_LIMIT = "step_limit"
NO_OVERDISPERSION = "no_overdispersion"
UNBOUNDED = "unbounded_coefficient"
NO_EVENTS = "no_events"
NOT_IDENTIFIED = "spline_not_identified"


@dataclass
class Solution:
    b: np.ndarray
    theta: np.ndarray
    status: list[str]


def independent(info: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """Columns that are no combination of earlier ones, by elimination."""
    p = len(info)
    a = info.copy()
    keep = np.zeros(p, dtype=bool)
    scale = np.diag(info).copy()
    for j in range(p):
        if (among is None or among[j]) and scale[j] > 0 and a[j, j] > 1e-10 * scale[j]:
            keep[j] = True
            a -= np.outer(a[:, j], a[j, :]) / a[j, j]
    return keep


def solve(info: np.ndarray, right: np.ndarray, free: np.ndarray) -> np.ndarray:
    out = np.zeros(len(info))
    if free.any():
        part = info[np.ix_(free, free)]
        try:
            out[free] = np.linalg.solve(part, right[free])
        except np.linalg.LinAlgError:
            out[free] = np.linalg.lstsq(part, right[free], rcond=None)[0]
    return out


def next_theta(theta: float, first: float, second: float) -> float:
    """Newton step on a bounded scale: log(theta), or 1/theta where that is small.

    Data without overdispersion push 1/theta to zero or below it; the result is
    then the limit, from where a later step may come back.
    """
    g, h = theta * first, theta * theta * second + theta * first
    if theta > 20:
        slope, bend = -theta * g, theta * theta * (h + g)
        inverse = 1 / theta - slope / bend if bend < 0 else (0.0 if slope < 0 else 10 / theta)
        return 1 / min(max(inverse, 1 / THETA_LIMIT), 10 / theta)
    step = -g / h if h < 0 else np.sign(g)
    return theta * float(np.exp(np.clip(step, -1.5, 1.5)))


def maximise(
    likelihood: Likelihood,
    models: list[str],
    b: np.ndarray,
    bounds: np.ndarray,
    free: np.ndarray,
    theta: np.ndarray | None = None,
    fit_theta: bool = False,
    max_steps: int = MAX_STEPS,
) -> Solution:
    """Newton steps with halving, for every fit until it settles."""
    fits = len(models)
    status = [STEP_LIMIT] * fits
    pinned = [not fit_theta] * fits
    b = b.copy()
    theta = np.full(fits, np.nan) if theta is None else theta.copy()
    best_b, best_t = b.copy(), theta.copy()
    best_ll = np.full(fits, -np.inf)
    step_b = np.zeros_like(b)
    active = np.arange(fits)
    for step in range(max_steps):
        if not len(active):
            break
        s = likelihood([models[i] for i in active], b[active], bounds[active], theta[active])
        still = []
        for k, i in enumerate(active):
            ll, gain = s.ll[k], s.ll[k] - best_ll[i]
            if not gain >= -1e-9 * (abs(ll) + 1):
                # Overshot: come back half way, in coefficients and log(theta).
                step_b[i] /= 2
                b[i] = best_b[i] + step_b[i]
                theta[i] = np.sqrt(best_t[i] * theta[i])
                still.append(i)
                continue
            best_b[i], best_t[i], best_ll[i] = b[i], theta[i], ll
            step_b[i] = solve(s.info[k], s.score[k], free[i])
            b[i] = best_b[i] + step_b[i]
            moved = 0.0
            # At the limit the slope decides: it may still lead back.
            if theta[i] >= THETA_LIMIT * (1 - 1e-9) and fit_theta:
                pinned[i] = pinned[i] or s.scalars["dtheta"][k] > 0
            if not pinned[i]:
                theta[i] = next_theta(theta[i], s.scalars["dtheta"][k], s.scalars["ddtheta"][k])
                moved = abs(np.log(theta[i] / best_t[i]))
            small = np.abs(step_b[i]).max(initial=0) < STEP_TOLERANCE and moved < STEP_TOLERANCE
            # A coefficient running off to infinity no longer changes the likelihood.
            flat = step > 3 and moved < 1e-4 and gain < LIKELIHOOD_TOLERANCE * (abs(ll) + 1)
            if small or flat:
                runs_off = np.abs(step_b[i]).max(initial=0) > 0.1
                settled = NO_OVERDISPERSION if fit_theta and pinned[i] else CONVERGED
                status[i] = UNBOUNDED if runs_off else settled
            else:
                still.append(i)
        active = np.array(still, dtype=int)
    return Solution(b, theta, status)


@dataclass
class FitResult:
    """Fitted models of one batch, with everything later steps need.

    A batch holds every group once per label, a label naming the terms used.
    """

    design: Design
    likelihood: Likelihood
    models: list[str]
    labels: list[str]
    used: np.ndarray
    cells: np.ndarray
    bounds: np.ndarray
    b: np.ndarray
    free: np.ndarray
    theta: np.ndarray
    status: list[str]
    stats: Stats
    covariance: np.ndarray

    @property
    def usable(self) -> list[int]:
        return [i for i, s in enumerate(self.status) if s not in (NO_EVENTS, NOT_IDENTIFIED)]

    @property
    def family(self) -> str:
        return self.design.model.family


def _facts(rows: DataFrame, model: RateModel) -> list:
    spline = [
        f(t.column).cast("double").alias(f"{name}{i}")
        for i, t in enumerate(model.splines)
        for name, f in (("low", F.min), ("high", F.max))
    ]
    return (
        rows.groupBy("model_id")
        .agg(
            F.sum("f").alias("cells"),
            F.sum(F.col("f") * F.col("y")).alias("events"),
            F.sum(F.col("f") * F.col("n")).alias("people"),
            *spline,
        )
        .orderBy("model_id")
        .collect()
    )


def _columns_of(design: Design, terms: tuple[Term, ...]) -> np.ndarray:
    """Which design columns belong to the intercept and ``terms``."""
    mask = [True]
    for term, block in zip(design.model.terms, design.blocks):
        mask += [term in terms] * len(block)
    return np.array(mask)


def _fit_rows(
    rows: DataFrame, patterns: DataFrame, design: Design, facts: list, variants: dict[str, tuple[Term, ...]]
) -> FitResult:
    model = design.model
    kinds = [(label, terms, r) for label, terms in variants.items() for r in facts]
    models = [r["model_id"] for _, _, r in kinds]
    p, m = len(design.names), len(kinds)
    used = np.array([_columns_of(design, terms) for _, terms, _ in kinds])
    bounds = np.zeros((m, 2 * len(model.splines)))
    status = [CONVERGED] * m
    b = np.zeros((m, p))
    for i, (_, terms, r) in enumerate(kinds):
        for j, term in enumerate(model.splines):
            low, high = r[f"low{j}"], r[f"high{j}"]
            if low < min(term.knots) and max(term.knots) < high:
                bounds[i, 2 * j : 2 * j + 2] = low, high
            else:
                # Any range with the knots inside serves when the term is not used.
                bounds[i, 2 * j : 2 * j + 2] = min(term.knots) - 1, max(term.knots) + 1
                if term in terms:
                    status[i] = NOT_IDENTIFIED
        if r["events"] == 0:
            status[i] = NO_EVENTS
        else:
            b[i, 0] = np.log(r["events"] / r["people"])
    if m == 1 and status[0] == NOT_IDENTIFIED:
        raise ValueError(f"the spline is not identified on its range in the data: {model.splines}")
    nb = model.family == NEGATIVE_BINOMIAL
    likelihood = Likelihood(rows, design, nb)
    cells = np.array([r["cells"] for _, _, r in kinds])
    theta, free = np.full(m, np.nan), np.zeros((m, p), dtype=bool)
    covariance = np.zeros((m, p, p))
    stats = Stats(np.zeros((m, p, p)), {"sr": np.zeros((m, p))}, {"ll": np.zeros(m)})
    todo = [i for i, s in enumerate(status) if s == CONVERGED]
    if todo:
        names = [models[i] for i in todo]
        poisson = Likelihood(patterns, design, False)
        # Which columns are independent does not depend on the weights.
        first = poisson(names, b[todo], bounds[todo])
        free[todo] = [independent(first.info[k], used[i]) for k, i in enumerate(todo)]
        start = b[todo] + [solve(first.info[k], first.score[k], free[i]) for k, i in enumerate(todo)]
        if nb:
            alpha = first.scalars["excess"] / first.scalars["mu2"]
            theta0 = 1 / np.clip(alpha, 1e-2, 1e2)
            solution = maximise(likelihood, names, start, bounds[todo], free[todo], theta0, fit_theta=True)
            theta[todo] = solution.theta
        else:
            solution = maximise(poisson, names, start, bounds[todo], free[todo])
        b[todo] = solution.b
        for k, i in enumerate(todo):
            status[i] = solution.status[k]
        stats = likelihood(names, b[todo], bounds[todo], theta[todo], full=True).spread(todo, m)
        for i in todo:
            part = np.ix_(free[i], free[i])
            covariance[i][part] = np.linalg.pinv(stats.info[i][part])
    labels = [label for label, _, _ in kinds]
    return FitResult(
        design, likelihood, models, labels, used, cells, bounds, b, free, theta, status, stats, covariance
    )


def fit_slices(
    df: DataFrame,
    model: RateModel,
    scratch: Scratch,
    by: str | None = None,
    name: str = "model",
    variants: dict[str, tuple[Term, ...]] | None = None,
) -> Iterator[FitResult]:
    """Fit ``model`` to all of ``df``, or to every group of ``by`` at once.

    ``variants`` names subsets of the model's terms to fit side by side, on
    the complete cases of the whole model.

    Yields one result, or several if the groups are too many for the driver to
    hold their matrices together. Then the compressed cells are stored by slice
    and every slice reads its own part only.
    """
    variants = variants or {"": model.terms}
    rows = scratch.keep(compress(df, model, by), f"{name}_rows")
    design = Design(model, find_levels(rows, model))
    slices = 1
    if by:
        groups = rows.select("model_id").distinct().count()
        slices = max(1, -(-groups * len(variants) * len(design.names) ** 2 // DRIVER_ENTRIES))
    if slices > 1:
        of = F.pmod(F.xxhash64("model_id"), F.lit(slices)).cast("int")
        rows = scratch.keep(rows.withColumn("slice", of), f"{name}_sliced", "slice")
    for number in range(slices):
        part = rows if slices == 1 else rows.filter(F.col("slice") == number).drop("slice")
        facts = _facts(part, model)
        if not facts and slices > 1:
            continue
        if not facts:
            raise ValueError("no complete cases with people to fit")
        patterns = part
        if model.family == POISSON:
            patterns = scratch.keep(sum_events(part, model), f"{name}_patterns{number}")
        yield _fit_rows(part, patterns, design, facts, variants)


def fit(
    df: DataFrame,
    model: RateModel,
    scratch: Scratch,
    by: str | None = None,
    name: str = "model",
    variants: dict[str, tuple[Term, ...]] | None = None,
) -> FitResult:
    """Fit one model, or few groups; see ``fit_slices`` for very many groups."""
    results = list(fit_slices(df, model, scratch, by, name, variants))
    if len(results) > 1:
        raise ValueError("too many groups for one result: use fit_slices")
    return results[0]
