from datetime import date

import pytest
from pyspark.sql import functions as F

from ratelab.functions import special
from ratelab.functions.columns import age_band, caseless, exposure, nonblank, starts_with_any, sum_known, sum_strict
from ratelab.operators.filters import drop_month, keep_month, latest_period
from ratelab.operators.quality import factor_levels, missing_numerator, wide_strata
from ratelab.operators.rates import rate_table


def test_age_band_counts_year_boundaries(spark):
    df = spark.createDataFrame([(date(1950, 12, 31),), (date(1996, 12, 31),)], "dob date")
    assert [r[0] for r in df.select(age_band("dob", date(1996, 1, 1))).collect()] == [45, 0]


def test_exposure_keeps_missing(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "q int")
    assert [tuple(r) for r in df.select(exposure("q", 2), exposure("q", 3)).collect()] == [
        (1, 1), (0, 1), (0, 0), (None, None),
    ]


def test_blank_and_prefix_tests(spark):
    df = spark.createDataFrame([("a1",), ("  ",), ("",), (None,), ("21",)], "s string")
    assert df.filter(nonblank("s")).count() == 2
    assert [r[0] for r in df.filter(starts_with_any("s", ("1", "2"))).collect()] == ["21"]


def test_sums_with_missing(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("c", None)], "k string, x int")
    got = df.groupBy("k").agg(sum_known("x"), sum_strict("x")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 1, None), ("b", 2, 2), ("c", 0, None)]


def test_rates_and_limits(spark):
    df = spark.createDataFrame([(1, 37, 400), (2, 500, 400), (3, 5, 0)], "g int, attends int, persons int")
    got = {r["g"]: r for r in rate_table(df, ["g"]).collect()}
    assert got[1]["lcl"] == pytest.approx(0.06785393449857381, abs=1e-12)
    assert got[2]["lcl"] is None and got[2]["prop"] == 1.25
    assert got[3]["prop"] is None
    wide = rate_table(df, ["g"], divisor=12).filter("g = 1").first()
    assert wide["prop"] == pytest.approx(got[1]["prop"])
    assert wide["lcl"] < got[1]["lcl"] and wide["ucl"] > got[1]["ucl"]


def test_special_functions(spark):
    import math

    points = [0.01, 0.5, 1.0, 3.7, 20.0, 1234.5, 1e5]
    df = spark.createDataFrame([(x,) for x in points], "x double")
    got = df.select("x", special.log_gamma("x"), special.digamma("x"), special.trigamma("x")).collect()
    for x, lg, dg, tg in got:
        assert lg == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
        h = 1e-4 * max(x, 0.1)
        assert dg == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-4)
    by_x = {r[0]: r for r in got}
    assert by_x[1.0][2] == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert by_x[1.0][3] == pytest.approx(math.pi**2 / 6, abs=1e-13)


def test_period_filters(spark):
    days = [date(2023, 7, 1), date(2023, 8, 1), date(2023, 12, 31), None]
    df = spark.createDataFrame([(d,) for d in days], "month date")
    assert keep_month(df, 2023, 7).count() == 1
    assert keep_month(df, 2023, 12).count() == 1
    assert drop_month(df, 2023, 8).count() == 2
    assert latest_period(df).first()[0] == date(2023, 12, 31)


def test_wide_strata_and_gaps(spark):
    rows = [(1, 15, "F", 2), (1, 15, "F", 3), (1, 30, "M", None), (2, 15, "F", 1), (2, 30, "M", 4)]
    df = spark.createDataFrame(rows, "month int, age int, sex string, n int")
    got = wide_strata(df, "month", ["age", "sex"], "n").orderBy("month")
    assert got.columns == ["month", "15_F", "30_M"]
    assert [tuple(r) for r in got.collect()] == [(1, 5, None), (2, 1, 4)]
    cells = spark.createDataFrame([(1, 10, 2), (2, 10, None)], "month int, persons int, attends int")
    assert [r["month"] for r in missing_numerator(cells, ["month"]).collect()] == [2]


def test_wide_strata_leave_nothing_out(spark):
    rows = [(1, 105, "F", 2), (1, None, "F", 3), (2, 15, None, 4), (None, 15, "F", 5)]
    df = spark.createDataFrame(rows, "month int, age int, sex string, n int")
    got = wide_strata(df, "month", ["age", "sex"], "n").orderBy("month")
    assert got.columns == ["month", "NA_F", "15_NA", "15_F", "105_F"]
    assert [tuple(r) for r in got.collect()] == [(None, None, None, 5, None), (1, 3, None, None, 2), (2, None, 4, None, None)]
    assert wide_strata(df.limit(0), "month", ["age", "sex"], "n").columns == ["month"]
    with pytest.raises(ValueError, match="same column name"):
        wide_strata(spark.createDataFrame([(1, "a_b", "c", 1), (1, "a", "b_c", 1)], "month int, x string, y string, n int"), "month", ["x", "y"], "n")


def test_levels_sort_as_numbers(spark):
    df = spark.createDataFrame([(105,), (15,), (90,), (None,)], "a int")
    assert [r[0] for r in factor_levels(df, "a").collect()] == [15, 90, 105]


def test_caseless_text(spark):
    a = spark.createDataFrame([("North",)], "b string")
    b = spark.createDataFrame([("NORTH  ", 1)], "b string, n int")
    assert a.join(b, "b").count() == 0
    assert caseless(a, "b").join(caseless(b, "b"), "b").first()["n"] == 1
