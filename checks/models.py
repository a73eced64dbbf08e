"""Rate models beside SQL that finds the same maximum by another method.

The library takes Newton steps on all coefficients at once. The SQL cycles
through the factors instead: iterative proportional fitting for Poisson,
one-factor score steps for the negative binomial, bisection for limits.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from checks.catalog import _PERIOD_TABLE
from checks.derived import derived_tables, stored_cells, window_cells, windows_sql
from checks.registry import query, rounded
from ratelab.models.design import (
    NEGATIVE_BINOMIAL,
    POISSON,
    Categorical,
    Numeric,
    RateModel,
    natural_spline,
)
from ratelab.models.fit import fit
from ratelab.models.inference import compare_aic, forest_table, keep_term, sequential_deviance, summary, tidy
from ratelab.models.levels import fit_absorbed, tidy_absorbed
from ratelab.models.mixed import GAUSSIAN, fit_random_intercept, tidy_mixed
from ratelab.operators.membership import events_in_periods
from ratelab.plans import study
from ratelab.scratch import Scratch
from ratelab.sources.calendar import spanning

ADJUSTED = (*study.AGE_SEX, Numeric("deprived"))


def model_table(spark, sf_dir):
    return study.features(study.attendance_table(stored_cells(spark, sf_dir)))


_CELLS = """
cell AS (SELECT age_band AS a, gender AS g, CASE WHEN quintile < 2 THEN 1 ELSE 0 END AS d, borough AS bo, month_no,
 1 AS one, CAST(persons AS DOUBLE) AS n, CAST(attends AS BIGINT) AS y FROM period_table WHERE persons > 0)"""
# The same with the second exposure and spline columns made orthogonal over months.
_SEASON_CELLS = """
sp0 AS (SELECT month_no, sum(persons) AS w, (month_no - lo) / (hi - lo) AS u, (4 - lo) / (hi - lo) AS k1,
  (8 - lo) / (hi - lo) AS k2 FROM period_table, (SELECT CAST(min(month_no) AS DOUBLE) AS lo, max(month_no) AS hi
  FROM period_table) GROUP BY month_no, lo, hi),
sp1 AS (SELECT month_no, w, u, u ** 3 - (greatest(u - k2, 0) ** 3) / (1 - k2) AS s2,
 (greatest(u - k1, 0) ** 3) / (1 - k1) - (greatest(u - k2, 0) ** 3) / (1 - k2) AS s3 FROM sp0),
sp2 AS (SELECT month_no, w, u - sum(w * u) OVER () / sum(w) OVER () AS z1, s2 - sum(w * s2) OVER () / sum(w) OVER () AS s2,
 s3 - sum(w * s3) OVER () / sum(w) OVER () AS s3 FROM sp1),
sp3 AS (SELECT month_no, w, z1, s2 - z1 * sum(w * s2 * z1) OVER () / sum(w * z1 * z1) OVER () AS z2,
 s3 - z1 * sum(w * s3 * z1) OVER () / sum(w * z1 * z1) OVER () AS s3 FROM sp2),
sp4 AS (SELECT month_no, z1, z2, s3 - z2 * sum(w * s3 * z2) OVER () / sum(w * z2 * z2) OVER () AS z3 FROM sp3),
cell AS (SELECT age_band AS a, gender AS g, CASE WHEN quintile < 2 THEN 1 ELSE 0 END AS d,
 CASE WHEN quintile < 3 THEN 1 ELSE 0 END AS e, borough AS bo, practice_code AS pr, month_no, z1, z2, z3,
 CAST(persons AS DOUBLE) AS n, CAST(attends AS BIGINT) AS y FROM period_table JOIN sp4 USING (month_no) WHERE persons > 0)"""
_PATTERNS = """
pat AS (SELECT a, g, d, CAST(sum(y) AS DOUBLE) AS y, sum(n) AS n FROM cell GROUP BY a, g, d)"""
_IPF = """
ipf AS (SELECT 0 AS k, a, g, d, y, n, n AS mu FROM pat
 UNION ALL SELECT k + 1, a, g, d, y, n, mu * CASE k % 3
  WHEN 0 THEN sum(y) OVER (PARTITION BY a) / sum(mu) OVER (PARTITION BY a)
  WHEN 1 THEN sum(y) OVER (PARTITION BY g) / sum(mu) OVER (PARTITION BY g)
  ELSE sum(y) OVER (PARTITION BY d) / sum(mu) OVER (PARTITION BY d) END
 FROM ipf WHERE k < 180)"""
# Fitted log rates per pattern, and the weights behind the standard error.
_POISSON = """
fitted AS (SELECT a, g, d, n, mu, ln(mu / n) AS eta FROM ipf WHERE k = 180)"""
_BASE = "(SELECT min(a) FROM {t})"


def _contrasts(source: str) -> str:
    """Rate ratios of each level against the first, from fitted log rates."""
    return f"""
SELECT concat('age_band', CAST(t.a AS VARCHAR)) AS term, round(exp(avg(t.eta - b.eta)), 6) AS estimate
FROM {source} t JOIN {source} b ON b.a = (SELECT min(a) FROM {source}) AND t.g = b.g AND t.d = b.d AND t.a <> b.a
GROUP BY t.a
UNION ALL SELECT concat('gender', t.g), round(exp(avg(t.eta - b.eta)), 6)
FROM {source} t JOIN {source} b ON b.g = (SELECT min(g) FROM {source}) AND t.a = b.a AND t.d = b.d AND t.g <> b.g
GROUP BY t.g
UNION ALL SELECT 'deprived', round(exp(avg(t.eta - b.eta)), 6)
FROM {source} t JOIN {source} b ON b.d = 0 AND t.d = 1 AND t.a = b.a AND t.g = b.g"""


def _fit(spark, sf_dir, terms, family, by=None):
    with Scratch(spark) as scratch:
        return fit(model_table(spark, sf_dir), RateModel("attends", terms, family), scratch, by)


@query(
    "poisson_crude_irr",
    """
SELECT 'deprived' AS term,
 round((sum(y) FILTER (d = 1) / sum(n) FILTER (d = 1)) / (sum(y) FILTER (d = 0) / sum(n) FILTER (d = 0)), 6) AS estimate,
 round(sqrt(1.0 / sum(y) FILTER (d = 1) + 1.0 / sum(y) FILTER (d = 0)), 6) AS std_error FROM cell""",
    _PERIOD_TABLE,
    _CELLS,
)
def poisson_crude(spark, sf_dir):
    table = study.rate_ratio(model_table(spark, sf_dir), family=POISSON, adjust=(), method="wald")
    return rounded(table.select("term", "estimate", "std_error"), "estimate", "std_error")


@query("poisson_adjusted", _contrasts("fitted"), _PERIOD_TABLE, _CELLS, _PATTERNS, _IPF, _POISSON)
def poisson_adjusted(spark, sf_dir):
    fitted = _fit(spark, sf_dir, ADJUSTED, POISSON)
    return rounded(forest_table(tidy(fitted, spark)).select("term", "estimate"), "estimate")


_RESIDUAL = """
res AS (SELECT 0 AS k, a, g, d, mu, CAST(d AS DOUBLE) AS x FROM fitted
 UNION ALL SELECT k + 1, a, g, d, mu, x - CASE k % 2
  WHEN 0 THEN sum(mu * x) OVER (PARTITION BY a) / sum(mu) OVER (PARTITION BY a)
  ELSE sum(mu * x) OVER (PARTITION BY g) / sum(mu) OVER (PARTITION BY g) END
 FROM res WHERE k < 120)"""


@query(
    "poisson_adjusted_error",
    """
SELECT 'deprived' AS term, round(e, 6) AS estimate, round(s, 6) AS std_error, round(ln(e) / s, 6) AS statistic,
 round(e * exp(-1.959963984540054 * s), 6) AS conf_low, round(e * exp(1.959963984540054 * s), 6) AS conf_high
FROM (SELECT exp(avg(t.eta - b.eta)) AS e FROM fitted t JOIN fitted b ON b.d = 0 AND t.d = 1 AND t.a = b.a AND t.g = b.g),
 (SELECT 1 / sqrt(sum(mu * x * x)) AS s FROM res WHERE k = 120)""",
    _PERIOD_TABLE, _CELLS, _PATTERNS, _IPF, _POISSON, _RESIDUAL,
)
def poisson_adjusted_error(spark, sf_dir):
    table = study.rate_ratio(model_table(spark, sf_dir), family=POISSON, method="wald")
    numbers = ["estimate", "std_error", "statistic", "conf_low", "conf_high"]
    return rounded(table.select("term", *numbers), *numbers)


_ROWS = """
cellmu AS (SELECT c.y, c.n * exp(f.eta) AS mu FROM cell c JOIN fitted f USING (a, g, d))"""


@query(
    "poisson_summary",
    """
SELECT n, n - k AS df_residual, round(2 * dev, 6) AS deviance, round(pearson / (n - k), 6) AS pearson_ratio,
 round(ll, 6) AS loglik, round(-2 * ll + 2 * k, 6) AS aic FROM
 (SELECT count(*) AS n, sum(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu)) AS dev,
  sum((y - mu) * (y - mu) / mu) AS pearson, sum(y * ln(mu) - mu - lgamma(y + 1)) AS ll FROM cellmu),
 (SELECT count(DISTINCT a) + count(DISTINCT g) + count(DISTINCT d) - 2 AS k FROM pat)""",
    _PERIOD_TABLE, _CELLS, _PATTERNS, _IPF, _POISSON, _ROWS,
)
def poisson_summary(spark, sf_dir):
    table = summary(_fit(spark, sf_dir, ADJUSTED, POISSON), spark)
    table = table.select("n", "df_residual", "deviance", "pearson_ratio", "loglik", "aic")
    return rounded(table, "deviance", "pearson_ratio", "loglik", "aic")


@query(
    "pearson_ratio",
    """
SELECT round(sum((y - mu) * (y - mu) / mu) / (count(*) - 2), 6) AS pearson_ratio FROM
 (SELECT y, n * (sum(y) OVER (PARTITION BY d)) / (sum(n) OVER (PARTITION BY d)) AS mu FROM cell)""",
    _PERIOD_TABLE,
    _CELLS,
)
def pearson_ratio(spark, sf_dir):
    table = summary(_fit(spark, sf_dir, (Numeric("deprived"),), POISSON), spark)
    return rounded(table.select("pearson_ratio"), "pearson_ratio")


@query(
    "nb_saturated_ratio",
    """
SELECT 'deprived' AS term, round(avg(y) FILTER (d = 1) / avg(y) FILTER (d = 0), 6) AS estimate FROM cell""",
    _PERIOD_TABLE,
    _CELLS,
)
def nb_saturated_ratio(spark, sf_dir):
    # Without an offset the fitted means are the group means, whatever the dispersion.
    table = model_table(spark, sf_dir).withColumn("persons", F.lit(1))
    out = study.rate_ratio(table, adjust=(), method="wald")
    return rounded(out.select("term", "estimate"), "estimate")


def _nb(
    group: str,
    name: str = "nb",
    cycles: int = 80,
    parts: tuple[str, ...] = ("a", "g", "d"),
    curves: bool = False,
    theta: str = "",
) -> list[str]:
    """Negative binomial fit per ``group``: score steps one term at a time, then one for log(theta).

    A factor's levels move together; a spline column ``z`` moves on its own.
    Given ``theta``, that value stays.
    """
    bends = ["z1", "z2", "z3"] if curves else []
    last = len(parts) + len(bends)
    every, steps = last + 1, cycles * (last + 1)
    keys = ", ".join(dict.fromkeys([*([group] if group else []), *parts, *bends]))
    of_key = " ".join(f"WHEN {i} THEN CAST({part} AS VARCHAR)" for i, part in enumerate(parts))
    of_z = " ".join(f"WHEN {len(parts) + i} THEN {z}" for i, z in enumerate(bends)) or "WHEN -1 THEN 1"
    whole = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    block = f"OVER (PARTITION BY {', '.join([*([group] if group else []), 'key'])})"
    return [
        f"""
{name}_rows AS (SELECT {keys}, n, y, CAST(count(*) AS DOUBLE) AS f FROM cell GROUP BY ALL)""",
        f"""
{name} AS (SELECT 0 AS k, {keys}, n, y, f, ln(sum(f * y) {whole} / sum(f * n) {whole}) AS eta,
  CAST({theta or 10} AS DOUBLE) AS th FROM {name}_rows
 UNION ALL SELECT k + 1, {keys}, n, y, f,
  CASE WHEN k % {every} < {last} THEN eta + z * s1 / s2 ELSE eta END,
  CASE WHEN k % {every} < {last} OR {'true' if theta else 'false'} THEN th ELSE least(1e5, th * exp(greatest(-1.5, least(1.5,
   CASE WHEN th * th * s2 + th * s1 < 0 THEN -th * s1 / (th * th * s2 + th * s1) ELSE sign(s1) END)))) END
 FROM (SELECT *, sum(v1) {block} AS s1, sum(v2) {block} AS s2 FROM
  (SELECT *,
    CASE WHEN k % {every} < {last} THEN f * z * (y - mu) / (1 + mu / th)
     ELSE f * (coalesce(list_sum(list_transform(range(y), lambda j: 1.0 / (th + j))), 0)
      - ln(1 + mu / th) + (mu - y) / (mu + th)) END AS v1,
    CASE WHEN k % {every} < {last} THEN f * z * z * mu / (1 + mu / th)
     ELSE f * (mu / (th * (mu + th)) - (mu - y) / ((mu + th) * (mu + th))
      - coalesce(list_sum(list_transform(range(y), lambda j: 1.0 / ((th + j) * (th + j)))), 0)) END AS v2
   FROM (SELECT *, n * exp(eta) AS mu, CASE k % {every} {of_key} ELSE '' END AS key,
     CASE k % {every} {of_z} ELSE 1.0 END AS z FROM {name} WHERE k < {steps}))))""",
        f"""
{name}_fit AS (SELECT {keys}, max(eta) AS eta, max(th) AS th FROM {name} WHERE k = {steps} GROUP BY ALL)""",
    ]


@query("nb_adjusted", _contrasts("nb_fit"), _PERIOD_TABLE, _CELLS, *_nb(""))
def nb_adjusted(spark, sf_dir):
    fitted = _fit(spark, sf_dir, ADJUSTED, NEGATIVE_BINOMIAL)
    return rounded(forest_table(tidy(fitted, spark)).select("term", "estimate"), "estimate")


@query(
    "nb_summary",
    """
SELECT round(max(th), 4) AS theta, count(*) AS n, round(2 * sum(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END
  - (y + th) * ln((y + th) / (mu + th))), 6) AS deviance,
 round(sum((y - mu) * (y - mu) / (mu + mu * mu / th)) / (count(*) - max(k)), 6) AS pearson_ratio,
 round(sum(lgamma(y + th) - lgamma(th) - lgamma(y + 1) + th * ln(th / (mu + th)) + y * ln(mu / (mu + th))), 4) AS loglik
FROM (SELECT c.y, c.n * exp(f.eta) AS mu, f.th FROM cell c JOIN nb_fit f USING (a, g, d)),
 (SELECT count(DISTINCT a) + count(DISTINCT g) + count(DISTINCT d) - 2 AS k FROM pat)""",
    _PERIOD_TABLE, _CELLS, _PATTERNS, *_nb(""),
)
def nb_summary(spark, sf_dir):
    table = summary(_fit(spark, sf_dir, ADJUSTED, NEGATIVE_BINOMIAL), spark)
    table = table.select(F.round("theta", 4).alias("theta"), "n", "deviance", "pearson_ratio", F.round("loglik", 4).alias("loglik"))
    # Differences of log-gammas lose digits when theta is large.
    return rounded(table, "deviance", "pearson_ratio")


@query(
    "nb_per_borough",
    """
SELECT t.bo AS model_id, 'deprived' AS term, round(exp(avg(t.eta - b.eta)), 5) AS estimate
FROM nb_fit t JOIN nb_fit b ON t.bo = b.bo AND b.d = 0 AND t.d = 1 AND t.a = b.a AND t.g = b.g GROUP BY t.bo
UNION ALL SELECT bo, 'deprived', NULL FROM nb_fit GROUP BY bo HAVING min(d) = max(d)""",
    _PERIOD_TABLE, _CELLS, *_nb("bo"),
)
def nb_per_borough(spark, sf_dir):
    table = study.rate_ratio(model_table(spark, sf_dir), by="borough", method="wald")
    return table.select("model_id", "term", (F.round("estimate", 5) + F.lit(0.0)).alias("estimate"))


@query(
    "nb_crude_per_borough",
    """
SELECT t.bo AS model_id, 'deprived' AS term, round(exp(max(t.eta) - max(b.eta)), 5) AS estimate
FROM nb_fit t JOIN nb_fit b ON t.bo = b.bo AND b.d = 0 AND t.d = 1 GROUP BY t.bo
UNION ALL SELECT bo, 'deprived', NULL FROM nb_fit GROUP BY bo HAVING min(d) = max(d)""",
    _PERIOD_TABLE, _CELLS, *_nb("bo", parts=("d",)),
)
def nb_crude_per_borough(spark, sf_dir):
    table = study.rate_ratio(model_table(spark, sf_dir), by="borough", adjust=(), method="wald")
    return table.select("model_id", "term", (F.round("estimate", 5) + F.lit(0.0)).alias("estimate"))


_CRUDE = """
crude AS (SELECT sum(y) FILTER (d = 1) AS y1, sum(y) AS yy, sum(n) FILTER (d = 1) AS n1,
  sum(n) FILTER (d = 0) AS n0 FROM cell)"""
_BISECT = """
top AS (SELECT *, ln((y1 / n1) / ((yy - y1) / n0)) AS best FROM crude),
target AS (SELECT *, y1 * best - yy * ln(n0 + n1 * exp(best)) - 3.841458820694124 / 2 AS goal FROM top),
bis AS (SELECT 0 AS k, s, best AS near, best + s * 5.0 AS far FROM target, (VALUES (-1), (1)) AS v(s)
 UNION ALL SELECT k + 1, s,
  CASE WHEN y1 * (near + far) / 2 - yy * ln(n0 + n1 * exp((near + far) / 2)) > goal THEN (near + far) / 2 ELSE near END,
  CASE WHEN y1 * (near + far) / 2 - yy * ln(n0 + n1 * exp((near + far) / 2)) > goal THEN far ELSE (near + far) / 2 END
 FROM bis, target WHERE k < 60)"""


@query(
    "profile_limits_crude",
    """
SELECT 'deprived' AS term, round(exp(max(best)), 6) AS estimate, round(exp(min(near)), 6) AS conf_low,
 round(exp(max(near)), 6) AS conf_high FROM bis, target WHERE k = 60""",
    _PERIOD_TABLE, _CELLS, _CRUDE, _BISECT,
)
def profile_limits_crude(spark, sf_dir):
    table = study.rate_ratio(model_table(spark, sf_dir), family=POISSON, adjust=(), method="profile")
    numbers = ["estimate", "conf_low", "conf_high"]
    return rounded(table.select("term", *numbers), *numbers)


_COLLAPSED = """
cell AS (SELECT age_band AS a, gender AS g, CASE WHEN quintile < 2 THEN 1 ELSE 0 END AS d, CAST(sum(persons) AS DOUBLE) AS n,
 CAST(coalesce(sum(attends), 0) AS BIGINT) AS y FROM study
 GROUP BY borough, pcn_name, practice_code, practice_name, quintile, age_band, gender)"""


@query("nb_admissions_collapsed", _contrasts("nb_fit"), _COLLAPSED, *_nb(""))
def nb_admissions(spark, sf_dir):
    cells = stored_cells(spark, sf_dir).withColumnRenamed("attends", "admits")
    table = study.features(study.admission_table(cells))
    coefficients = study.run_specification(study.SPECIFICATIONS["final_admits"], table)
    return rounded(forest_table(coefficients).select("term", "estimate"), "estimate")


# Bisection for the exposure's coefficient; between two trials the other
# factors settle again, dispersion held at the full fit.
_PROFILE = """
peak AS (SELECT avg(t.eta - b.eta) AS beta FROM nb_fit t JOIN nb_fit b ON b.d = 0 AND t.d = 1 AND t.a = b.a AND t.g = b.g),
goal AS (SELECT sum(f * (y * (ln(n) + eta) - (y + th) * ln(n * exp(eta) + th))) - 3.841458820694124 / 2 AS goal
 FROM nb_rows JOIN nb_fit USING (a, g, d)),
prof AS (SELECT 0 AS k, s, a, g, d, n, y, f, eta - beta * d AS e0, th, beta AS near, beta + s * 2.0 AS far,
  beta + s * 1.0 AS cur FROM nb_rows JOIN nb_fit USING (a, g, d), peak, (VALUES (-1), (1)) AS v(s)
 UNION ALL SELECT k + 1, s, a, g, d, n, y, f, CASE WHEN k % 13 < 12 THEN e0 + s1 / s2 ELSE e0 END, th,
  CASE WHEN k % 13 = 12 AND s1 > goal THEN cur ELSE near END,
  CASE WHEN k % 13 = 12 AND s1 <= goal THEN cur ELSE far END,
  CASE WHEN k % 13 < 12 THEN cur WHEN s1 > goal THEN (cur + far) / 2 ELSE (near + cur) / 2 END
 FROM (SELECT *, sum(v1) OVER (PARTITION BY s, key) AS s1, sum(v2) OVER (PARTITION BY s, key) AS s2 FROM
  (SELECT *, CASE WHEN k % 13 < 12 THEN f * (y - mu) / (1 + mu / th)
    ELSE f * (y * ln(mu) - (y + th) * ln(mu + th)) END AS v1, f * mu / (1 + mu / th) AS v2
   FROM (SELECT *, n * exp(e0 + cur * d) AS mu, CASE WHEN k % 13 = 12 THEN '' WHEN k % 13 % 2 = 0
     THEN CAST(a AS VARCHAR) ELSE g END AS key FROM prof WHERE k < 390))), goal)"""


@query(
    "profile_limits",
    """
SELECT 'deprived' AS term, round(exp(max(beta)), 5) AS estimate, round(exp(min(near)), 5) AS conf_low,
 round(exp(max(near)), 5) AS conf_high FROM prof, peak WHERE k = 390""",
    _PERIOD_TABLE, _CELLS, *_nb(""), _PROFILE,
)
def profile_limits(spark, sf_dir):
    table = study.rate_ratio(model_table(spark, sf_dir))
    return table.select("term", *[F.round(c, 5).alias(c) for c in ("estimate", "conf_low", "conf_high")])


_NESTED = """
nested AS (SELECT t, 0 AS k, a, g, d, y, n, n AS mu FROM pat, (VALUES (0), (1), (2), (3)) AS v(t)
 UNION ALL SELECT t, k + 1, a, g, d, y, n, mu * CASE
  WHEN k % 4 = 0 THEN sum(y) OVER (PARTITION BY t) / sum(mu) OVER (PARTITION BY t)
  WHEN k % 4 = 1 AND t >= 1 THEN sum(y) OVER (PARTITION BY t, a) / sum(mu) OVER (PARTITION BY t, a)
  WHEN k % 4 = 2 AND t >= 2 THEN sum(y) OVER (PARTITION BY t, g) / sum(mu) OVER (PARTITION BY t, g)
  WHEN k % 4 = 3 AND t >= 3 THEN sum(y) OVER (PARTITION BY t, d) / sum(mu) OVER (PARTITION BY t, d)
  ELSE 1 END
 FROM nested WHERE k < 200),
steps AS (SELECT f.t, 2 * sum(CASE WHEN c.y > 0 THEN c.y * ln(c.y / (c.n * f.mu / f.n)) ELSE 0 END
  - (c.y - c.n * f.mu / f.n)) AS dev FROM cell c JOIN nested f USING (a, g, d) WHERE f.k = 200 GROUP BY f.t)"""


@query(
    "sequential_deviance",
    """
SELECT CASE t WHEN 0 THEN 'NULL' WHEN 1 THEN 'age_band' WHEN 2 THEN 'gender' ELSE 'deprived' END AS term,
 round(lag(dev) OVER (ORDER BY t) - dev, 5) AS deviance, round(dev, 5) AS residual_deviance FROM steps""",
    _PERIOD_TABLE, _CELLS, _PATTERNS, _NESTED,
)
def deviance_table(spark, sf_dir):
    return _deviances(spark, sf_dir, POISSON, 5)


def _deviances(spark, sf_dir, family, digits):
    # The nested fits read the compressed rows again, so they come before clearing.
    with Scratch(spark) as scratch:
        fitted = fit(model_table(spark, sf_dir), RateModel("attends", ADJUSTED, family), scratch)
        table = sequential_deviance(fitted, spark)
    numbers = {c: F.round(c, digits) + F.lit(0.0) for c in ("deviance", "residual_deviance")}
    return table.select("term", *numbers).withColumns(numbers)


_NESTED_NB = [
    *_nb(""),
    *[
        cte
        for i, parts in enumerate([("one",), ("a",), ("a", "g"), ("a", "g", "d")])
        for cte in _nb("", f"nest{i}", 60, parts, theta="(SELECT max(th) FROM nb_fit)")
    ],
]


def _nested_sql(i: int, keys: str) -> str:
    return f"""
SELECT {i} AS t, 2 * sum(CASE WHEN c.y > 0 THEN c.y * ln(c.y / (c.n * exp(f.eta))) ELSE 0 END
 - (c.y + f.th) * ln((c.y + f.th) / (c.n * exp(f.eta) + f.th))) AS dev FROM cell c JOIN nest{i}_fit f USING ({keys})"""


@query(
    "sequential_deviance_nb",
    """
SELECT CASE t WHEN 0 THEN 'NULL' WHEN 1 THEN 'age_band' WHEN 2 THEN 'gender' ELSE 'deprived' END AS term,
 round(lag(dev) OVER (ORDER BY t) - dev, 4) AS deviance, round(dev, 4) AS residual_deviance FROM ("""
    + " UNION ALL ".join(_nested_sql(i, keys) for i, keys in enumerate(["one", "a", "a, g", "a, g, d"]))
    + ")",
    _PERIOD_TABLE, _CELLS, *_NESTED_NB,
)
def deviance_table_nb(spark, sf_dir):
    return _deviances(spark, sf_dir, NEGATIVE_BINOMIAL, 4)


@query(
    "aic_table",
    """
SELECT 'poisson' AS model, k AS df, round(ll, 4) AS loglik, round(-2 * ll + 2 * k, 4) AS aic FROM
 (SELECT sum(y * ln(mu) - mu - lgamma(y + 1)) AS ll FROM cellmu), size
UNION ALL SELECT 'negative_binomial', k + 1, round(ll, 4), round(-2 * ll + 2 * (k + 1), 4) FROM
 (SELECT sum(lgamma(y + th) - lgamma(th) - lgamma(y + 1) + th * ln(th / (mu + th)) + y * ln(mu / (mu + th))) AS ll
  FROM (SELECT c.y, c.n * exp(f.eta) AS mu, f.th FROM cell c JOIN nb_fit f USING (a, g, d))), size""",
    _PERIOD_TABLE, _CELLS, _PATTERNS, _IPF, _POISSON, _ROWS, *_nb(""),
    """
size AS (SELECT count(DISTINCT a) + count(DISTINCT g) + count(DISTINCT d) - 2 AS k FROM pat)""",
)
def aic_table(spark, sf_dir):
    table = model_table(spark, sf_dir)
    with Scratch(spark) as scratch:
        fits = {
            family: fit(table, RateModel("attends", ADJUSTED, family), scratch, name=family)
            for family in (POISSON, NEGATIVE_BINOMIAL)
        }
    out = compare_aic(fits, spark)
    return out.select("model", "df", F.round("loglik", 4).alias("loglik"), F.round("aic", 4).alias("aic"))


def _comparison_sql(x: str, term: str) -> tuple[str, list[str]]:
    sets = {
        "Age, Sex, Seasonality": (("a", "g", x), True),
        "Seasonality": ((x,), True),
        "None": ((x,), False),
    }
    extra, parts = [], []
    for i, (label, (factors, curves)) in enumerate(sets.items()):
        name = f"nb{i}"
        extra += _nb("bo", name, 60, factors, curves)
        same = " AND ".join(f"t.{k} = b.{k}" for k in ("bo", *factors[:-1], *(["z1"] if curves else [])))
        parts.append(
            f"""
SELECT t.bo AS model_id, '{term}' AS term, '{label}' AS adjustment, round(exp(avg(t.eta - b.eta)), 4) AS estimate
FROM {name}_fit t JOIN {name}_fit b ON b.{x} = 0 AND t.{x} = 1 AND {same} GROUP BY t.bo
UNION ALL SELECT bo, '{term}', '{label}', NULL FROM {name}_fit GROUP BY bo HAVING min({x}) = max({x})"""
        )
    return " UNION ALL ".join(parts), extra


def _comparison(spark, sf_dir, exposed):
    table = study.adjustment_comparison(model_table(spark, sf_dir), exposed=exposed)
    estimate = F.round("estimate", 4) + F.lit(0.0)
    return table.select("model_id", "term", "adjustment", estimate.alias("estimate"))


_SQL_Q1, _EXTRA_Q1 = _comparison_sql("d", "deprived")
_SQL_Q12, _EXTRA_Q12 = _comparison_sql("e", "deprived2")


@query("adjustment_comparison", _SQL_Q1, _PERIOD_TABLE, _SEASON_CELLS, *_EXTRA_Q1)
def adjustment_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir, "deprived")


@query("adjustment_comparison_q12", _SQL_Q12, _PERIOD_TABLE, _SEASON_CELLS, *_EXTRA_Q12)
def adjustment_comparison_q12(spark, sf_dir):
    return _comparison(spark, sf_dir, "deprived2")


@query(
    "nb_borough_and_season",
    """
SELECT concat('borough', t.bo) AS term, round(exp(avg(t.eta - b.eta)), 4) AS estimate FROM nb_fit t
JOIN nb_fit b ON b.bo = (SELECT min(bo) FROM nb_fit) AND t.bo <> b.bo AND t.a = b.a AND t.g = b.g AND t.e = b.e
 AND t.z1 = b.z1 GROUP BY t.bo
UNION ALL SELECT 'deprived2', round(exp(avg(t.eta - b.eta)), 4) FROM nb_fit t
JOIN nb_fit b ON b.e = 0 AND t.e = 1 AND t.a = b.a AND t.g = b.g AND t.bo = b.bo AND t.z1 = b.z1""",
    _PERIOD_TABLE, _SEASON_CELLS, *_nb("", cycles=60, parts=("a", "g", "e", "bo"), curves=True),
)
def nb_borough_and_season(spark, sf_dir):
    terms = (*study.AGE_SEX, Numeric("deprived2"), Categorical("borough"), *study.SEASON)
    table = forest_table(tidy(_fit(spark, sf_dir, terms, NEGATIVE_BINOMIAL), spark))
    kept = table.filter(F.col("term").startswith("borough") | (F.col("term") == "deprived2"))
    return kept.select("term", (F.round("estimate", 4) + F.lit(0.0)).alias("estimate"))


_SPLINE = """
months AS (SELECT CAST(d AS DATE) AS month, CAST(row_number() OVER (ORDER BY d) AS DOUBLE) AS x
 FROM (SELECT unnest(generate_series(date_trunc('month', min(episode_start))::TIMESTAMP,
  date_trunc('month', max(episode_start))::TIMESTAMP, INTERVAL 1 MONTH)) AS d FROM encounter)),
seen AS (SELECT m.x, count(*) AS n FROM months m JOIN encounter e ON e.episode_start >= m.month
 AND e.episode_start < m.month + INTERVAL 1 MONTH GROUP BY m.x),
unit AS (SELECT x, n, (x - lo) / (hi - lo) AS u, (4 - lo) / (hi - lo) AS k1, (8 - lo) / (hi - lo) AS k2
 FROM seen, (SELECT min(x) AS lo, max(x) AS hi FROM seen)),
part AS (SELECT x, n, u, (u * u * u - greatest(u - 1, 0) ** 3) AS d0,
 (greatest(u - k1, 0) ** 3 - greatest(u - 1, 0) ** 3) / (1 - k1) AS d1,
 (greatest(u - k2, 0) ** 3 - greatest(u - 1, 0) ** 3) / (1 - k2) AS d2 FROM unit)"""


@query(
    "spline_basis",
    """
SELECT CAST(x AS INT) AS month_no, n, round(u, 6) AS s1, round(d0 - d2, 6) AS s2, round(d1 - d2, 6) AS s3 FROM part""",
    _SPLINE,
)
def spline_basis(spark, sf_dir):
    events = derived_tables(spark, sf_dir)["encounter"]
    placed = events_in_periods(events, spanning(events, "episode_start"), "episode_start")
    seen = placed.groupBy("month_no").agg(F.count(F.lit(1)).alias("n"))
    # One row of two numbers.
    ends = F.broadcast(seen.agg(F.min("month_no").alias("low"), F.max("month_no").alias("high")))
    basis = natural_spline(F.col("month_no").cast("double"), F.col("low"), F.col("high"), (4.0, 8.0))
    out = seen.join(ends).select("month_no", "n", *[b.alias(f"s{i + 1}") for i, b in enumerate(basis)])
    return rounded(out, "s1", "s2", "s3")


# --- rolling years, two outcomes ------------------------------------------------


def _wide_cell(outcome: str, collapsed: bool) -> str:
    period = "" if collapsed else "month_no, "
    return f"""
cell AS (SELECT age_band AS a, gender AS g, CASE WHEN quintile < 2 THEN 1 ELSE 0 END AS d, borough AS bo, {period}1 AS one,
 CAST(sum(persons) AS DOUBLE) AS n, CAST(coalesce(sum({outcome}), 0) AS BIGINT) AS y FROM wide_study
 GROUP BY {period}borough, pcn_name, practice_code, practice_name, quintile, age_band, gender)"""


def _specified(spark, sf_dir, name):
    tables = study.model_tables(window_cells(spark, sf_dir, 1), window_cells(spark, sf_dir, 12))
    return study.run_specification(study.SPECIFICATIONS[name], tables)


def _estimates(spark, sf_dir, name):
    table = forest_table(_specified(spark, sf_dir, name))
    return table.select("term", (F.round("estimate", 5) + F.lit(0.0)).alias("estimate"))


_ROUND5 = "SELECT term, round(estimate, 5) AS estimate FROM ({})"


@query("collapsed_poisson", _ROUND5.format(_contrasts("fitted")), *windows_sql(1), _wide_cell("attends", True), _PATTERNS, _IPF, _POISSON)
def collapsed_poisson(spark, sf_dir):
    return _estimates(spark, sf_dir, "collapsed_poisson")


@query("collapsed_nb_admits", _ROUND5.format(_contrasts("nb_fit")), *windows_sql(1), _wide_cell("admits", True), *_nb(""))
def collapsed_nb_admits(spark, sf_dir):
    return _estimates(spark, sf_dir, "collapsed_nb_admits")


@query("year_poisson", _ROUND5.format(_contrasts("fitted")), *windows_sql(12), _wide_cell("attends", False), _PATTERNS, _IPF, _POISSON)
def year_poisson(spark, sf_dir):
    return _estimates(spark, sf_dir, "year_poisson")


@query("year_nb", _ROUND5.format(_contrasts("nb_fit")), *windows_sql(12), _wide_cell("attends", False), *_nb(""))
def year_nb(spark, sf_dir):
    return _estimates(spark, sf_dir, "year_nb")


@query(
    "year_nb_borough",
    """
SELECT t.bo AS model_id, 'deprived' AS term, round(exp(avg(t.eta - b.eta)), 4) AS estimate
FROM nb_fit t JOIN nb_fit b ON t.bo = b.bo AND b.d = 0 AND t.d = 1 AND t.a = b.a AND t.g = b.g GROUP BY t.bo
UNION ALL SELECT bo, 'deprived', NULL FROM nb_fit GROUP BY bo HAVING min(d) = max(d)""",
    *windows_sql(12), _wide_cell("attends", False), *_nb("bo"),
)
def year_nb_borough(spark, sf_dir):
    table = keep_term(_specified(spark, sf_dir, "year_nb_borough"), "deprived")
    return table.select("model_id", "term", (F.round("estimate", 4) + F.lit(0.0)).alias("estimate"))


# --- absorbed factor --------------------------------------------------------------


@query(
    "nb_absorbed_practice",
    """
SELECT concat('age_band', CAST(t.a AS VARCHAR)) AS term, round(exp(avg(t.eta - b.eta)), 4) AS estimate, round(max(t.th), 3) AS theta
FROM nb_fit t JOIN nb_fit b ON b.a = (SELECT min(a) FROM nb_fit) AND t.a <> b.a AND t.pr = b.pr AND t.z1 = b.z1 GROUP BY t.a
UNION ALL SELECT concat('practice', t.pr), round(exp(avg(t.eta - b.eta)), 4), round(max(t.th), 3)
FROM nb_fit t JOIN nb_fit b ON b.pr = (SELECT min(pr) FROM nb_fit) AND t.pr <> b.pr AND t.a = b.a AND t.z1 = b.z1 GROUP BY t.pr""",
    _PERIOD_TABLE, _SEASON_CELLS, *_nb("", cycles=60, parts=("a", "pr"), curves=True),
)
def nb_absorbed_practice(spark, sf_dir):
    # Sex and deprivation are constant within a practice of these tables.
    model = RateModel("attends", (Categorical("age_band"), *study.SEASON), NEGATIVE_BINOMIAL)
    with Scratch(spark) as scratch:
        fitted = fit_absorbed(model_table(spark, sf_dir), model, "practice_code", scratch)
        first = fitted.effects.agg(F.min_by("effect", "level")).first()[0]
        levels = [(f"practice{r['level']}", math.exp(r["effect"] - first)) for r in fitted.effects.orderBy("level").collect()[1:]]
    ages = tidy_absorbed(fitted, spark).filter(F.col("term").startswith("age_band")).select("term", "estimate")
    table = ages.unionAll(spark.createDataFrame(levels, "term string, estimate double"))
    return table.select("term", (F.round("estimate", 4) + F.lit(0.0)).alias("estimate"), F.round(F.lit(fitted.theta), 3).alias("theta"))


# --- random intercepts ----------------------------------------------------------


# Per cell: score, curvature, its slope and the expected curvature, along the predictor.
_ALONG = {
    POISSON: ("y - mu", "mu", "mu", "mu"),
    NEGATIVE_BINOMIAL: (
        "(y - mu) * th / (th + mu)", "mu * th * (th + y) / ((th + mu) * (th + mu))",
        "th * (th + y) * mu * (th - mu) / ((th + mu) * (th + mu) * (th + mu))", "mu / (1 + mu / th)",
    ),
    # th is the residual variance.
    GAUSSIAN: ("(y - ln(n) - eta - u) / th", "1 / th", "0.0", "1 / th"),
}
_CELL_LL = {
    POISSON: "y * ln(mu) - mu - lgamma(y + 1)",
    NEGATIVE_BINOMIAL: "lgamma(y + th) - lgamma(th) - lgamma(y + 1) + th * ln(th / (mu + th)) + y * ln(mu / (mu + th))",
    GAUSSIAN: "-0.5 * (ln(2 * pi() * th) + power(y - ln(n) - eta - u, 2) / th)",
}


def _mixed_sql(family: str, parts: tuple[str, ...], curves: bool = False, cycles: int = 60) -> list[str]:
    """Laplace likelihood with an intercept u per borough, climbed one kind of number at a time.

    A cycle takes one Newton step for every u, re-centres them and moves their
    variance s2 to where its slope would vanish, then scales the levels of one
    factor after another (a spline column alone), then moves th. Each rests
    only where its own slope of the whole likelihood, its curvature term
    included, is zero.
    """
    bends = ["z1", "z2", "z3"] if curves else []
    nb, gauss = family == NEGATIVE_BINOMIAL, family == GAUSSIAN
    last = 2 + len(parts) + len(bends)
    every, steps = last + 1, cycles * (last + 1)
    keys = ", ".join(["bo", *parts, *bends])
    of_key = " ".join(f"WHEN {2 + i} THEN CAST({part} AS VARCHAR)" for i, part in enumerate(parts))
    of_z = " ".join(f"WHEN {2 + len(parts) + i} THEN {z}" for i, z in enumerate(bends)) or "WHEN -1 THEN 1"
    score, curve, third, weight = _ALONG[family]
    start = "sum(f * (y - ln(n))) OVER () / sum(f) OVER ()" if gauss else "ln(sum(f * y) OVER () / sum(f * n) OVER ())"
    # Poisson cells of one pattern and borough add up.
    source = (
        f"SELECT {keys}, sum(n) AS n, sum(y) AS y, 1.0 AS f FROM cell GROUP BY ALL" if family == POISSON
        else f"SELECT {keys}, n, y, CAST(count(*) AS DOUBLE) AS f FROM cell GROUP BY ALL"
    )
    if nb:
        slope = """f * (coalesce(list_sum(list_transform(range(y), lambda j: 1.0 / (th + j))), 0) - ln(1 + mu / th) + (mu - y) / (mu + th))"""
        bend = """f * (mu / (th * (mu + th)) - (mu - y) / ((mu + th) * (mu + th))
          - coalesce(list_sum(list_transform(range(y), lambda j: 1.0 / ((th + j) * (th + j)))), 0))"""
        curve_t = "f * mu * (2 * th * mu + y * mu - y * th) / ((th + mu) * (th + mu) * (th + mu))"
        score_t = "f * (y - mu) * mu / ((th + mu) * (th + mu))"
        when = lambda v: f"CASE WHEN t = {last} THEN {v} ELSE 0 END"
        theta_rows = f", {when(slope)} AS d1, {when(bend)} AS d2, {when(curve_t)} AS ct, {when(score_t)} AS st"
        theta_groups = ", sum(ct) OVER (PARTITION BY bo) AS gct, sum(st) OVER (PARTITION BY bo) AS gst"
        theta_all = """, sum(d1) OVER () - 0.5 * sum((gct + gt * gst / (gc + 1 / s2)) / (gc + 1 / s2) / cnt) OVER () AS l1, sum(d2) OVER () AS l2"""
        theta = """least(1e5, th * exp(greatest(-1.0, least(1.0, CASE WHEN th * th * l2 + th * l1 < 0 THEN -th * l1 / (th * th * l2 + th * l1) ELSE sign(l1) END))))"""
    elif gauss:
        theta_rows, theta_groups = "", ""
        theta_all = """, sum(f * power(y - ln(n) - eta - u, 2)) OVER () AS l1, sum(f) OVER () - sum(s2 * gc / (1 + s2 * gc) / cnt) OVER () AS l2"""
        theta = "l1 / l2"
    else:
        theta_rows = theta_groups = theta_all = ""
        theta = "th"
    return [
        f"""
mix_rows AS ({source})""",
        f"""
mix AS (SELECT 0 AS k, {keys}, n, y, f, {start} AS eta, 0.0::DOUBLE AS u, 0.25::DOUBLE AS s2, 10.0::DOUBLE AS th,
  count(*) OVER (PARTITION BY bo) AS cnt FROM mix_rows
 UNION ALL SELECT k + 1, {keys}, n, y, f,
  CASE WHEN t = 1 THEN eta + shift WHEN t > 1 AND t < {last} THEN eta + z * b1 / b2 ELSE eta END,
  CASE t WHEN 0 THEN u + (gs - u / s2) / (gc + 1 / s2) WHEN 1 THEN u - shift ELSE u END,
  CASE t WHEN 1 THEN greatest(s2 * q1 / q2, 1e-8) ELSE s2 END, CASE t WHEN {last} THEN {theta} ELSE th END, cnt
 FROM (SELECT *, sum(u * u / s2 / cnt) OVER () AS q1,
   sum((s2 * gc + gt * u / (gc + 1 / s2)) / (1 + s2 * gc) / cnt) OVER () AS q2,
   sum((u - s2 * 0.5 * gt / (gc + 1 / s2) / (1 + s2 * gc)) / cnt) OVER () / sum(1.0 / cnt) OVER () AS shift,
   sum(f * z * (s - 0.5 * t3 / (gc + 1 / s2) + 0.5 * gt * c / ((gc + 1 / s2) * (gc + 1 / s2)))) OVER (PARTITION BY key) AS b1,
   sum(f * z * z * w) OVER (PARTITION BY key) AS b2{theta_all}
  FROM (SELECT *, sum(f * s) OVER (PARTITION BY bo) AS gs, sum(f * c) OVER (PARTITION BY bo) AS gc,
    sum(f * t3) OVER (PARTITION BY bo) AS gt{theta_groups}
   FROM (SELECT *, {score} AS s, {curve} AS c, {third} AS t3, {weight} AS w{theta_rows}
    FROM (SELECT *, n * exp(eta + u) AS mu, k % {every} AS t, CASE k % {every} {of_key} ELSE '' END AS key,
      CASE k % {every} {of_z} ELSE 1.0 END AS z FROM mix WHERE k < {steps})))))""",
        f"""
mix_fit AS (SELECT {keys}, max(eta) AS eta, max(u) AS u, max(s2) AS s2, max(th) AS th FROM mix WHERE k = {steps} GROUP BY ALL)""",
        f"""
mix_ll AS (SELECT sum(ll - u * u / (2 * s2) - 0.5 * ln(1 + s2 * c)) AS ll, max(sqrt(s2)) AS spread, max(th) AS th FROM
 (SELECT bo, sum({_CELL_LL[family]}) AS ll, sum({curve}) AS c, max(u) AS u, max(s2) AS s2, max(th) AS th
  FROM (SELECT *, n * exp(eta + u) AS mu FROM cell JOIN mix_fit USING ({keys})) GROUP BY bo))""",
    ]


def _mixed_rows(parts: tuple[str, ...], names: dict[str, str], curves: bool, transform: str, extra: str) -> str:
    """Contrasts of each factor's levels with the first, beside spread and likelihood."""
    out = []
    for part, name in names.items():
        same = " AND ".join(f"t.{k} = b.{k}" for k in ["bo", *[q for q in parts if q != part], *(["z1"] if curves else [])])
        out.append(
            f"SELECT {name} AS term, {transform}(avg(t.eta - b.eta)) AS estimate FROM mix_fit t JOIN mix_fit b"
            f" ON b.{part} = (SELECT min({part}) FROM mix_fit) AND t.{part} <> b.{part} AND {same} GROUP BY t.{part}"
        )
    return f"""
SELECT term, round(estimate, 5) AS estimate, round(spread, 4) AS spread, round(ll, 3) AS loglik{extra} FROM ({" UNION ALL ".join(out)}), mix_ll"""


_AGE_SEX_TERMS = {"a": "concat('age_band', CAST(t.a AS VARCHAR))", "g": "concat('gender', t.g)"}


def _mixed(spark, sf_dir, family, exposed="deprived", extra=()):
    model = RateModel("attends", (*study.AGE_SEX, Numeric(exposed), *extra), family)
    with Scratch(spark) as scratch:
        fitted = fit_random_intercept(model_table(spark, sf_dir), model, "borough", scratch)
    table = tidy_mixed(fitted, spark)
    # Spline coefficients depend on the basis, which is another one in the SQL.
    table = table.filter(~F.col("term").startswith("month_no") & (F.col("term") != "(Intercept)"))
    table = table.select("term", (F.round("estimate", 5) + F.lit(0.0)).alias("estimate"))
    found = {"spread": F.round(F.lit(fitted.spread), 4), "loglik": F.round(F.lit(fitted.loglik), 3)}
    if family == NEGATIVE_BINOMIAL:
        found["theta"] = F.round(F.lit(fitted.theta), 3)
    if family == GAUSSIAN:
        found["residual"] = F.round(F.lit(fitted.residual), 4)
    return table.withColumns(found)


@query(
    "mixed_intercept_poisson",
    _mixed_rows(("a", "g", "d"), {**_AGE_SEX_TERMS, "d": "'deprived'"}, False, "exp", ""),
    _PERIOD_TABLE, _CELLS, *_mixed_sql(POISSON, ("a", "g", "d")),
)
def mixed_poisson(spark, sf_dir):
    return _mixed(spark, sf_dir, POISSON)


@query(
    "mixed_intercept_poisson_season",
    _mixed_rows(("a", "g", "e"), {**_AGE_SEX_TERMS, "e": "'deprived2'"}, True, "exp", ""),
    _PERIOD_TABLE, _SEASON_CELLS, *_mixed_sql(POISSON, ("a", "g", "e"), True),
)
def mixed_poisson_season(spark, sf_dir):
    return _mixed(spark, sf_dir, POISSON, "deprived2", study.SEASON)


@query(
    "mixed_intercept_nb",
    _mixed_rows(("a", "g", "d"), {**_AGE_SEX_TERMS, "d": "'deprived'"}, False, "exp", ", round(th, 3) AS theta"),
    _PERIOD_TABLE, _CELLS, *_mixed_sql(NEGATIVE_BINOMIAL, ("a", "g", "d")),
)
def mixed_nb(spark, sf_dir):
    return _mixed(spark, sf_dir, NEGATIVE_BINOMIAL)


@query(
    "mixed_intercept_gaussian",
    _mixed_rows(("a", "g", "d"), {**_AGE_SEX_TERMS, "d": "'deprived'"}, False, "", ", round(sqrt(th), 4) AS residual"),
    _PERIOD_TABLE, _CELLS, *_mixed_sql(GAUSSIAN, ("a", "g", "d")),
)
def mixed_gaussian(spark, sf_dir):
    return _mixed(spark, sf_dir, GAUSSIAN)
