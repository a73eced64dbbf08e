"""Factors of any size: absorbed fixed effects and random intercepts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelab.models.design import NEGATIVE_BINOMIAL, POISSON, Categorical, NaturalSpline, Numeric, RateModel
from ratelab.models.fit import fit
from ratelab.models.levels import fit_absorbed, tidy_absorbed
from ratelab.models.mixed import fit_random_intercept
from ratelab.scratch import Scratch
from tests.test_models import simulate


@pytest.fixture
def scratch(spark):
    with Scratch(spark) as made:
        yield made


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(simulate(groups=6, per=120, theta=2.0, spread=0.6, seed=3)).cache()


@pytest.mark.parametrize("family", [POISSON, NEGATIVE_BINOMIAL])
def test_absorbed_is_the_categorical_model(spark, cells, scratch, family):
    terms = (Categorical("age"), Categorical("sex"), Numeric("d"), NaturalSpline("month_no"))
    want = fit(cells, RateModel("y", (*terms, Categorical("grp")), family), scratch, name="dense")
    got = fit_absorbed(cells, RateModel("y", terms, family), "grp", scratch)
    assert got.status == "converged" and (got.levels, got.left_out) == (6, 0)
    k = len(got.design.names)
    # Both stop where the likelihood is flat along the spline columns.
    assert got.b[1:] == pytest.approx(want.b[0][1:k], abs=1e-5)
    assert np.sqrt(np.diag(got.covariance))[1:] == pytest.approx(np.sqrt(np.diag(want.covariance[0]))[1:k], rel=1e-5)
    assert got.loglik == pytest.approx(want.stats.ll[0], abs=1e-6)
    if family == NEGATIVE_BINOMIAL:
        assert got.theta == pytest.approx(want.theta[0], rel=1e-6)
    effects = {r["level"]: r["effect"] for r in got.effects.collect()}
    apart = [effects[f"g{i}"] - effects["g0"] for i in range(1, 6)]
    assert apart == pytest.approx(want.b[0][k:], abs=1e-6)
    rows = {r["term"]: r for r in tidy_absorbed(got, spark).collect()}
    assert rows["d"]["estimate"] == pytest.approx(math.exp(got.b[got.design.names.index("d")]))
    assert "(Intercept)" not in rows


def test_levels_without_events_and_constant_columns(spark, cells, scratch):
    odd = cells.withColumn("y", F.when(F.col("grp") == "g2", 0).otherwise(F.col("y")))
    odd = odd.withColumn("of_group", F.when(F.col("grp") < "g3", 1).otherwise(0))
    model = RateModel("y", (Numeric("d"), Numeric("of_group")), POISSON)
    got = fit_absorbed(odd, model, "grp", scratch)
    alone = fit_absorbed(cells.filter("grp <> 'g2'"), RateModel("y", (Numeric("d"),), POISSON), "grp", scratch)
    assert (got.levels, got.left_out) == (5, 1) and got.b[1] == pytest.approx(alone.b[1], abs=1e-8)
    assert got.free.tolist() == [False, True, False]
    assert [r["estimate"] for r in tidy_absorbed(got, spark).collect()][1] is None
    none = fit_absorbed(cells.withColumn("y", F.lit(0)), model.__class__("y", (Numeric("d"),), POISSON), "grp", scratch)
    assert none.status == "no_events" and tidy_absorbed(none, spark).first()["estimate"] is None
    with pytest.raises(ValueError, match="no complete cases"):
        fit_absorbed(cells.limit(0), RateModel("y", (Numeric("d"),), POISSON), "grp", scratch)


def many(spark, groups, cells, spread):
    """Cells of very many groups, made by Spark."""
    u = (F.pmod(F.xxhash64("grp", F.lit(9)), F.lit(1 << 30)) / (1 << 30) - 0.5) * math.sqrt(12) * spread
    rows = spark.range(groups * cells).withColumn("grp", (F.col("id") % groups).cast("string"))
    rows = rows.withColumn("d", (F.col("id") / groups).cast("int") % 2).withColumn("persons", F.lit(50))
    mean = F.exp(F.log(F.lit(30.0)) + 0.3 * F.col("d") + u)
    return rows.withColumn("y", F.greatest(F.round(mean + F.sqrt(mean) * F.randn(5)), F.lit(0)).cast("int"))


def test_absorbed_of_five_thousand_levels(spark, scratch):
    """Against Newton steps on the likelihood given each level's events."""
    df = many(spark, 5_000, 4, 0.4).cache()
    got = fit_absorbed(df, RateModel("y", (Numeric("d"),), POISSON), "grp", scratch)
    table = df.groupBy("grp").agg(F.sum("y").alias("all"), F.sum(F.col("y") * F.col("d")).alias("of")).toPandas()
    b = 0.0
    for _ in range(30):
        share = math.exp(b) / (1 + math.exp(b))  # half of each level's persons are exposed
        b += (table["of"].sum() - share * table["all"].sum()) / (share * (1 - share) * table["all"].sum())
    assert got.b[1] == pytest.approx(b, abs=1e-8) and got.levels == 5_000


def test_random_intercept_of_200_000_groups(spark, scratch):
    df = many(spark, 200_000, 2, 0.4)
    got = fit_random_intercept(df, RateModel("y", (Numeric("d"),), POISSON), "grp", scratch)
    assert got.status == "converged" and got.groups == 200_000
    assert got.b[1] == pytest.approx(0.3, abs=0.01) and got.spread == pytest.approx(0.4, abs=0.05)
    assert got.intercepts.count() == 200_000
