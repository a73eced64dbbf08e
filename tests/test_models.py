"""Fits against a plain NumPy maximiser, another library and exact identities."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratelab.models import fit as fitting
from ratelab.models.design import (
    NEGATIVE_BINOMIAL,
    POISSON,
    Categorical,
    NaturalSpline,
    Numeric,
    RateModel,
    check_spline,
    natural_spline,
)
from ratelab.models.fit import NO_EVENTS, NO_OVERDISPERSION, NOT_IDENTIFIED, UNBOUNDED, fit, fit_slices, independent
from ratelab.models.inference import (
    chi_square_tail,
    compare_aic,
    forest_table,
    keep_term,
    profile_limits,
    scores,
    sequential_deviance,
    summary,
    tidy,
)
from ratelab.models.mixed import GAUSSIAN, fit_random_intercept, mixed_aic, summary_mixed, tidy_mixed
from ratelab.plans import study
from ratelab.scratch import Scratch

TERMS = (Categorical("age"), Categorical("sex"), Numeric("d"))


def simulate(groups=3, per=250, theta=1.5, spread=0.4, seed=7):
    rng = np.random.default_rng(seed)
    shift = rng.normal(0, spread, groups)
    rows = []
    for g in range(groups):
        for _ in range(per):
            age, sex, d = int(rng.integers(0, 3)) * 45, "FM"[rng.integers(0, 2)], int(rng.integers(0, 2))
            month, n = int(rng.integers(1, 13)), int(rng.integers(10, 120))
            mu = n * math.exp(-2.5 + 0.2 * (age == 45) - 0.3 * (age == 90) + 0.1 * (sex == "M") + 0.3 * d + shift[g])
            rows.append((f"g{g}", age, sex, d, month, n, int(rng.poisson(rng.gamma(theta, mu / theta)))))
    return pd.DataFrame(rows, columns=["grp", "age", "sex", "d", "month_no", "persons", "y"])


@pytest.fixture(scope="module")
def pdf():
    return simulate()


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).cache()


@pytest.fixture()
def scratch(spark):
    with Scratch(spark) as s:
        yield s


def matrix(pdf):
    columns = [np.ones(len(pdf)), pdf.age == 45, pdf.age == 90, pdf.sex == "M", pdf.d]
    return np.column_stack(columns).astype(float), pdf.y.to_numpy(float), np.log(pdf.persons.to_numpy(float))


LG = np.vectorize(math.lgamma)


def nb_loglik(par, x, y, o):
    mu, t = np.exp(x @ par[:-1] + o), math.exp(par[-1])
    terms = LG(y + t) - math.lgamma(t) - LG(y + 1) + t * np.log(t / (t + mu)) + y * np.log(mu / (t + mu))
    return float(terms.sum())


def poisson_loglik(par, x, y, o):
    eta = x @ par + o
    return float((y * eta - np.exp(eta) - LG(y + 1)).sum())


def climb(f, par, steps=40, fixed=()):
    """Newton with numerical derivatives."""
    par, free = np.array(par, float), [i for i in range(len(par)) if i not in fixed]
    e, q = 1e-4, len(free)
    for _ in range(steps):
        unit = np.eye(len(par))[free] * e
        g = np.array([(f(par + u) - f(par - u)) / (2 * e) for u in unit])
        h = np.array(
            [[(f(par + u + v) - f(par + u - v) - f(par - u + v) + f(par - u - v)) / (4 * e * e) for v in unit] for u in unit]
        )
        step = -np.linalg.solve(h, g)
        step *= min(1, 1 / np.abs(step).max())
        par[free] += step
        if np.abs(step).max() < 1e-8:
            break
    return par


def test_nb_matches_numpy(spark, pdf, df, scratch):
    x, y, o = matrix(pdf)
    want = climb(lambda p: nb_loglik(p, x, y, o), [-2.5, 0, 0, 0, 0, 0.3])
    got = fit(df, RateModel("y", TERMS), scratch)
    assert got.design.names == ["(Intercept)", "age45", "age90", "sexM", "d"]
    assert got.b[0] == pytest.approx(want[:-1], abs=1e-5)
    assert math.log(got.theta[0]) == pytest.approx(want[-1], abs=1e-5)
    row = summary(got, spark).first()
    assert row["loglik"] == pytest.approx(nb_loglik(want, x, y, o), abs=1e-6)
    assert row["aic"] == pytest.approx(-2 * row["loglik"] + 12)
    assert (row["n"], row["df_residual"], row["status"]) == (750, 745, "converged")
    mu, t = np.exp(x @ got.b[0] + o), got.theta[0]
    assert row["pearson_ratio"] == pytest.approx(((y - mu) ** 2 / (mu + mu**2 / t)).sum() / 745)
    info = (x * (mu / (1 + mu / t))[:, None]).T @ x
    errors = [r["std_error"] for r in tidy(got, spark).collect()]
    assert errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv(info))))
    assert max(abs(r["score"]) for r in scores(got, spark).collect()) < 1e-5


def test_profile_limits_match_numpy(spark, pdf, df, scratch):
    x, y, o = matrix(pdf)
    got = fit(df, RateModel("y", TERMS), scratch)
    (low, high) = profile_limits(got, [4])[(0, 4)]
    log_theta = math.log(got.theta[0])
    f = lambda p: nb_loglik(np.append(p, log_theta), x, y, o)
    top = f(got.b[0])
    for end in (low, high):
        start = got.b[0].copy()
        start[4] = end
        assert top - f(climb(f, start, fixed=(4,))) == pytest.approx(1.959963984540054**2 / 2, abs=1e-5)
    assert low < got.b[0, 4] < high


def test_poisson_matches_the_built_in(spark, df, scratch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    got = fit(df, RateModel("y", TERMS, POISSON), scratch)
    dummies = df.selectExpr(
        "y", "ln(persons) AS o", "int(age = 45) AS a", "int(age = 90) AS b", "int(sex = 'M') AS m", "d"
    )
    features = VectorAssembler(inputCols=["a", "b", "m", "d"], outputCol="x").transform(dummies)
    other = GeneralizedLinearRegression(
        family="poisson", link="log", offsetCol="o", labelCol="y", featuresCol="x", tol=1e-12
    ).fit(features)
    assert got.b[0] == pytest.approx([other.intercept, *other.coefficients], abs=1e-7)
    row = summary(got, spark).first()
    assert row["deviance"] == pytest.approx(other.summary.deviance)
    assert row["aic"] == pytest.approx(other.summary.aic)


def test_groups_fit_together_as_alone(spark, df, scratch):
    together = fit(df, RateModel("y", TERMS), scratch, by="grp")
    for i, name in enumerate(together.models):
        alone = fit(df.filter(F.col("grp") == name), RateModel("y", TERMS), scratch, name=name)
        assert together.b[i] == pytest.approx(alone.b[0], abs=1e-6)
        assert together.theta[i] == pytest.approx(alone.theta[0], rel=1e-5)


def test_slices_give_the_same(spark, df, scratch, monkeypatch):
    model = RateModel("y", TERMS)
    whole = tidy(fit(df, model, scratch, by="grp"), spark).collect()
    monkeypatch.setattr(fitting, "DRIVER_ENTRIES", 30)
    parts = list(fit_slices(df, model, scratch, by="grp", name="small"))
    assert len(parts) > 1
    got = {(r["model_id"], r["term"]): r["estimate"] for f in parts for r in tidy(f, spark).collect()}
    assert got == pytest.approx({(r["model_id"], r["term"]): r["estimate"] for r in whole}, rel=1e-7)
    sliced = study.rate_ratio(df, "y", exposed="d", adjust=TERMS[:2], by="grp", method="wald")
    assert sliced.count() == 3


def test_failed_groups_are_reported(spark, df, scratch):
    none = df.filter("grp = 'g0'").withColumns({"grp": F.lit("empty"), "y": F.lit(0).cast("long")})
    flat = df.filter("grp = 'g1' AND d = 0").withColumn("grp", F.lit("flat"))
    got = fit(df.unionByName(none).unionByName(flat), RateModel("y", TERMS), scratch, by="grp")
    status = dict(zip(got.models, got.status))
    assert status["empty"] == NO_EVENTS and status["g0"] == "converged"
    rows = {(r["model_id"], r["term"]): r["estimate"] for r in tidy(got, spark).collect()}
    assert rows["empty", "d"] is None and rows["flat", "d"] is None
    assert rows["flat", "sexM"] > 0 and rows["g0", "d"] > 0


def test_a_level_without_events_is_unbounded(spark, df, scratch):
    got = fit(df.withColumn("y", F.expr("IF(age = 90, 0, y)")), RateModel("y", TERMS, POISSON), scratch)
    assert got.status == [UNBOUNDED]
    rest = fit(df.filter("age < 90"), RateModel("y", TERMS, POISSON), scratch, name="rest")
    # The other coefficients are those of the data without the level.
    assert got.b[0, [0, 1, 3, 4]] == pytest.approx(rest.b[0], abs=1e-5)


def test_splitting_cells_leaves_poisson_alone(spark, df, scratch):
    one = fit(df, RateModel("y", TERMS, POISSON), scratch)
    halves = df.withColumns({"y": F.expr("y div 2"), "persons": F.expr("persons div 2")})
    rest = df.withColumns({"y": F.expr("y - y div 2"), "persons": F.expr("persons - persons div 2")})
    two = fit(halves.unionByName(rest), RateModel("y", TERMS, POISSON), scratch, name="two")
    assert one.b == pytest.approx(two.b, abs=1e-7)


def test_scaling_persons_moves_the_intercept_only(spark, df, scratch):
    one = fit(df, RateModel("y", TERMS), scratch)
    ten = fit(df.withColumn("persons", F.col("persons") * 10), RateModel("y", TERMS), scratch, name="ten")
    assert ten.b[0, 1:] == pytest.approx(one.b[0, 1:], abs=1e-7)
    assert ten.b[0, 0] == pytest.approx(one.b[0, 0] - math.log(10), abs=1e-7)


def test_no_overdispersion_tends_to_poisson(spark, scratch):
    rng = np.random.default_rng(3)
    # Binomial counts vary less than Poisson counts.
    rows = [(int(d), 50, int(rng.binomial(8, 0.3 + 0.1 * d))) for d in rng.integers(0, 2, 300)]
    df = spark.createDataFrame(rows, "d int, persons int, y int")
    nb = fit(df, RateModel("y", (Numeric("d"),)), scratch)
    poisson = fit(df, RateModel("y", (Numeric("d"),), POISSON), scratch, name="p")
    assert nb.status == [NO_OVERDISPERSION]
    assert nb.b == pytest.approx(poisson.b, abs=1e-3)
    assert summary(nb, spark).first()["se_theta"] is None


def test_weak_overdispersion_is_found_or_refused_by_its_slope(spark, scratch):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        for d in rng.integers(0, 2, 120):
            mu = 4.0 * math.exp(0.2 * d)
            rows.append((f"g{g:02d}", int(d), 100, int(rng.poisson(rng.gamma(150, mu / 150)))))
    df = spark.createDataFrame(rows, "grp string, d int, persons int, y int")
    got = fit(df, RateModel("y", (Numeric("d"),)), scratch, by="grp")
    assert set(got.status) == {"converged", NO_OVERDISPERSION}
    slope = got.theta * got.stats.scalars["dtheta"]
    for status, theta, s in zip(got.status, got.theta, slope):
        if status == NO_OVERDISPERSION:
            assert theta == pytest.approx(fitting.THETA_LIMIT) and s > 0
        else:
            assert theta < fitting.THETA_LIMIT / 2 and abs(s) < 1e-5


def test_complete_cases_and_zero_persons_are_dropped(spark, df, scratch):
    extra = df.limit(3).withColumn("y", F.lit(None).cast("long")).unionByName(
        df.limit(2).withColumn("persons", F.lit(0).cast("long"))
    )
    got = fit(df.unionByName(extra), RateModel("y", TERMS, POISSON), scratch)
    assert got.cells[0] == 750
    with pytest.raises(ValueError, match="no complete cases"):
        fit(df.limit(0), RateModel("y", TERMS), scratch, name="none")


def test_nested_deviances(spark, pdf, df, scratch):
    x, y, o = matrix(pdf)
    table = sequential_deviance(fit(df, RateModel("y", TERMS, POISSON), scratch), spark).collect()
    assert [r["term"] for r in table] == ["NULL", "age", "sex", "d"]
    assert [r["df"] for r in table] == [None, 2, 1, 1]
    full = summary(fit(df, RateModel("y", TERMS, POISSON), scratch), spark).first()["deviance"]
    assert table[-1]["residual_deviance"] == pytest.approx(full)
    age = climb(lambda p: poisson_loglik(p, x[:, :3], y, o), [-2.5, 0, 0])
    both = climb(lambda p: poisson_loglik(p, x[:, :4], y, o), [-2.5, 0, 0, 0])
    gain = 2 * (poisson_loglik(both, x[:, :4], y, o) - poisson_loglik(age, x[:, :3], y, o))
    assert table[2]["deviance"] == pytest.approx(gain, abs=1e-6)
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert chi_square_tail(12.591587243743977, 6) == pytest.approx(0.05)


def test_aic_refuses_other_responses(spark, df, scratch):
    a = fit(df, RateModel("y", (Numeric("d"),), POISSON), scratch, name="a")
    b = fit(df.withColumn("z", F.col("y")), RateModel("z", (Numeric("d"),), POISSON), scratch, name="b")
    assert compare_aic({"one": a}, spark).count() == 1
    with pytest.raises(ValueError, match="one response"):
        compare_aic({"one": a, "two": b}, spark)


def test_spline_spans_the_natural_splines(spark):
    df = spark.range(121).selectExpr("id / 10.0 + 1 AS x")
    basis = natural_spline(F.col("x").cast("double"), F.lit(1.0), F.lit(13.0), (4.0, 8.0))
    rows = np.array(df.select("x", *basis).collect(), float)
    assert rows.shape == (121, 4)
    second = np.diff(rows[:, 1:], n=2, axis=0)
    # Curvature vanishes at both ends and the columns are independent.
    assert np.abs(second[0]).max() < 0.05 * np.abs(second).max()
    assert np.abs(second[-1]).max() < 0.05 * np.abs(second).max()
    assert np.linalg.matrix_rank(np.column_stack([np.ones(121), rows[:, 1:]])) == 4


def test_spline_model_and_its_limits(spark, pdf, df, scratch):
    terms = (*TERMS, NaturalSpline("month_no"))
    got = fit(df, RateModel("y", terms, POISSON), scratch)
    u = (pdf.month_no.to_numpy(float) - 1) / 11
    points = [0, 3 / 11, 7 / 11, 1]
    slope = lambda k: (np.maximum(u - k, 0) ** 3 - np.maximum(u - 1, 0) ** 3) / (1 - k)
    x, y, o = matrix(pdf)
    x = np.column_stack([x, u, slope(0) - slope(points[2]), slope(points[1]) - slope(points[2])])
    want = climb(lambda p: poisson_loglik(p, x, y, o), [-2.5] + [0] * 7)
    assert got.b[0] == pytest.approx(want, abs=1e-5)
    with pytest.raises(ValueError, match="not identified"):
        fit(df.filter("month_no = 7"), RateModel("y", terms), scratch, name="one")
    with pytest.raises(ValueError, match="not identified"):
        check_spline(df.filter("month_no = 7"), NaturalSpline("month_no"))
    some = df.filter("grp = 'g0' OR month_no = 7")
    by = fit(some, RateModel("y", (Numeric("d"), NaturalSpline("month_no"))), scratch, by="grp", name="by")
    assert by.status[0] == "converged" and by.status[1:] == [NOT_IDENTIFIED] * 2


def test_dependent_columns_are_found():
    x = np.array([[1, 1, 0, 2], [1, 0, 1, 0], [1, 1, 0, 2], [1, 0, 1, 0]], float)
    assert independent(x.T @ x).tolist() == [True, True, False, False]


def test_comparison_and_forest(spark, df, scratch):
    table = df.withColumnsRenamed({"age": "age_band", "sex": "gender", "d": "deprived", "y": "attends"})
    rows = study.adjustment_comparison(table, by="grp")
    got = {(r["model_id"], r["adjustment"]): r["estimate"] for r in rows.collect()}
    assert len(got) == 9 and {a for _, a in got} == set(study.ADJUSTMENTS)
    for label, adjust in study.ADJUSTMENTS.items():
        model = RateModel("attends", (*adjust, Numeric("deprived")))
        alone = tidy(fit(table, model, scratch, "grp", label[:3]), spark, terms=["deprived"]).collect()
        assert [got[r["model_id"], label] for r in alone] == pytest.approx([r["estimate"] for r in alone], rel=1e-6)
    assert set(forest_table(rows).columns) == {
        "model_id", "adjustment", "term", "estimate", "conf_low", "conf_high"
    }
    assert keep_term(rows, "gender").count() == 0


def test_each_set_keeps_its_own_complete_cases(spark, df, scratch):
    table = df.withColumnsRenamed({"age": "age_band", "sex": "gender", "d": "deprived", "y": "attends"})
    holes = table.withColumn("age_band", F.when(F.col("persons") % 5 > 0, F.col("age_band")))
    rows = study.adjustment_comparison(holes, by="grp").filter("adjustment = 'None'").orderBy("model_id")
    model = RateModel("attends", (Numeric("deprived"),))
    alone = tidy(fit(table, model, scratch, "grp"), spark, terms=["deprived"]).collect()
    assert [r["estimate"] for r in rows.collect()] == pytest.approx([r["estimate"] for r in alone], rel=1e-6)


def test_specifications_run(spark, df):
    names = {"age": "age_band", "sex": "gender", "d": "deprived", "y": "attends", "grp": "borough"}
    table = df.withColumnsRenamed(names)
    mixed = study.run_specification(study.SPECIFICATIONS["month_poisson_random"], table)
    assert mixed.filter("term = 'deprived'").count() == 1
    grouped = study.run_specification(study.SPECIFICATIONS["month_nb_borough_crude"], table)
    assert grouped.filter("term = 'deprived'").count() == 3


def test_specifications_cover_the_study():
    specs = study.SPECIFICATIONS
    assert len(specs) == 26
    assert sum(s.random is not None for s in specs.values()) == 6
    assert sum(s.by is not None for s in specs.values()) == 8
    assert {s.model.response for s in specs.values()} == {"attends", "admits"}


# --- random intercepts ------------------------------------------------------------


@pytest.fixture(scope="module")
def clustered():
    return simulate(groups=10, per=90, theta=2.5, spread=0.5, seed=11)


def laplace(par, x, y, o, g, nb):
    p = x.shape[1]
    s, t, count = math.exp(par[p]), math.exp(par[p + 1]) if nb else None, g.max() + 1
    u, eta = np.zeros(count), x @ par[:p] + o
    for _ in range(50):
        mu = np.exp(eta + u[g])
        r, h = ((y - mu) * t / (t + mu), mu * t * (t + y) / (t + mu) ** 2) if nb else (y - mu, mu)
        step = (np.bincount(g, r) - u / s**2) / (np.bincount(g, h) + 1 / s**2)
        u += step
        if np.abs(step).max() < 1e-12:
            break
    mu = np.exp(eta + u[g])
    if nb:
        h = mu * t * (t + y) / (t + mu) ** 2
        ll = LG(y + t) - math.lgamma(t) - LG(y + 1) + t * np.log(t / (t + mu)) + y * np.log(mu / (t + mu))
    else:
        h, ll = mu, y * np.log(mu) - mu - LG(y + 1)
    return float(ll.sum() - (u**2).sum() / (2 * s**2) - np.log1p(s**2 * np.bincount(g, h)).sum() / 2)


@pytest.mark.parametrize("family", [POISSON, NEGATIVE_BINOMIAL])
def test_random_intercept_is_the_laplace_maximum(spark, clustered, scratch, family):
    nb = family == NEGATIVE_BINOMIAL
    got = fit_random_intercept(spark.createDataFrame(clustered), RateModel("y", TERMS, family), "grp", scratch)
    assert got.status == "converged"
    x, y, o = matrix(clustered)
    g = clustered.grp.str[1:].astype(int).to_numpy()
    par = np.array([*got.b, math.log(got.spread)] + ([math.log(got.theta)] if nb else []))
    f = lambda p: laplace(p, x, y, o, g, nb)
    assert got.loglik == pytest.approx(f(par), abs=1e-6)
    assert climb(f, par, steps=3) == pytest.approx(par, abs=2e-4)
    assert mixed_aic(got) == pytest.approx(-2 * got.loglik + 2 * len(par))
    assert tidy_mixed(got, spark).count() == 5
    assert summary_mixed(got, spark).first()["groups"] == 10


def test_gaussian_random_intercept(spark, clustered, scratch):
    df = spark.createDataFrame(clustered)
    got = fit_random_intercept(df, RateModel("y", TERMS, GAUSSIAN), "grp", scratch)
    x, y, o = matrix(clustered)
    g = clustered.grp.str[1:].astype(int).to_numpy()
    z = y - o

    def loglik(par):
        r, total = z - x @ par[:5], 0.0
        a, e = math.exp(2 * par[5]), math.exp(2 * par[6])
        for k in range(10):
            rk = r[g == k]
            n = len(rk)
            quad = (rk @ rk - a / (e + n * a) * rk.sum() ** 2) / e
            total -= 0.5 * (n * math.log(2 * math.pi * e) + math.log1p(n * a / e) + quad)
        return total

    par = np.array([*got.b, math.log(got.spread), math.log(got.residual)])
    assert got.loglik == pytest.approx(loglik(par), abs=1e-6)
    assert climb(loglik, par, steps=3) == pytest.approx(par, abs=1e-3)


def test_no_spread_is_reported(spark, pdf, scratch):
    rng = np.random.default_rng(5)
    rows = [(f"g{i % 4}", int(d), 100, int(rng.binomial(20, 0.2 + 0.05 * d))) for i, d in enumerate(rng.integers(0, 2, 200))]
    df = spark.createDataFrame(rows, "grp string, d int, persons int, y int")
    got = fit_random_intercept(df, RateModel("y", (Numeric("d"),), POISSON), "grp", scratch)
    assert got.status == "no_spread" and got.spread == pytest.approx(1e-4)


def test_random_intercepts_refuse_and_report(spark, scratch):
    rows = [(g, m, 1, 100, y) for g, y in (("a", 0), ("b", 0)) for m in range(1, 13)]
    none = spark.createDataFrame(rows, "g string, month_no int, x int, persons int, y int")
    fitted = fit_random_intercept(none, RateModel("y", (Numeric("x"),), POISSON), "g", scratch)
    assert fitted.status == "no_events"
    assert {r["status"] for r in tidy_mixed(fitted, spark).collect()} == {"no_events"}
    assert [r["estimate"] for r in tidy_mixed(fitted, spark).collect()] == [None, None]
    assert summary_mixed(fitted, spark).first()["loglik"] is None
    for table in (none.filter("month_no = 5"), none.filter("month_no < 7")):
        with pytest.raises(ValueError, match="not identified"):
            fit_random_intercept(table, RateModel("y", (NaturalSpline("month_no", (4.0, 8.0)),), POISSON), "g", scratch)
    with pytest.raises(ValueError, match="no complete cases"):
        fit_random_intercept(none.limit(0), RateModel("y", (Numeric("x"),), POISSON), "g", scratch)


def test_aic_of_random_intercepts_beside_plain_models(spark, scratch):
    rows = [(g, x, 100, y + x) for g, y in (("a", 5), ("b", 9), ("c", 30)) for x in (0, 1) for _ in range(4)]
    df = spark.createDataFrame(rows, "g string, x int, persons int, y int")
    model = RateModel("y", (Numeric("x"),), POISSON)
    fits = {"plain": fit(df, model, scratch), "random": fit_random_intercept(df, model, "g", scratch)}
    got = {r["model"]: r for r in compare_aic(fits, spark).collect()}
    assert (got["plain"]["df"], got["random"]["df"]) == (2, 3)
    assert got["random"]["aic"] < got["plain"]["aic"]
    assert got["random"]["aic"] == pytest.approx(-2 * got["random"]["loglik"] + 6)


def test_limits_in_small_batches_are_the_same(spark, scratch, monkeypatch):
    from ratelab.models import inference

    rows = [(g, x, 100, y + x * k) for g, y in (("a", 5), ("b", 9)) for x in (0, 1) for k in range(4)]
    df = spark.createDataFrame(rows, "g string, x int, persons int, y int")
    fitted = fit(df, RateModel("y", (Numeric("x"),), POISSON), scratch, "g")
    table = lambda: sorted(tidy(fitted, spark, method="profile").collect())
    steps = lambda: sorted(sequential_deviance(fitted, spark).collect(), key=repr)
    whole, deviances = table(), steps()
    monkeypatch.setattr(inference, "DRIVER_ENTRIES", 4)
    assert table() == whole and steps() == deviances
    assert {r["status"] for r in whole} == {"converged"}
