from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from checks.derived import patient_tables, stored_cells
from ratelab.operators import cells as c
from ratelab.operators.lookup import assign_lookup, compact_codes, unique_lookup
from ratelab.operators.membership import _counted, overlap_periods
from ratelab.session import broadcast_checked
from ratelab.sources.calendar import monthly

# quintile: persons, events, cells without events
EXPECTED = {1: (403, 13, 390), 2: (489, 16, 473), 3: (486, 18, 468), 4: (211, 5, 206), 5: (139, 3, 136)}


def key_rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def months(spark):
    """The 19 months the known numbers are for."""
    return monthly(spark, date(1995, 1, 1), 19)


def test_known_totals(spark, sf_dir, tmp_path):
    c.rate_cells(patient_tables(spark, sf_dir, calendar=months(spark))).write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    got = c.study_strata(cells).groupBy("quintile").agg(
        F.sum("persons"), F.sum("attends"), F.sum(F.col("attends").isNull().cast("int"))
    )
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == EXPECTED
    assert cells.count() == 1875
    assert cells.filter("quintile = 99").count() == 6
    assert cells.filter("quintile IS NULL").count() == 8


def test_a_person_with_a_third_of_all_rows(spark, sf_dir):
    """Their rows are counted before they move: few reach the shuffle by person."""
    t = patient_tables(spark, sf_dir)
    many = spark.range(3000).select((F.col("id") % 50).cast("int").alias("day"))
    hot = t.practice.filter("patient = 1").limit(1).crossJoin(F.broadcast(many)).withColumn(
        "period_start", F.date_add(F.lit("1995-01-01").cast("date"), F.col("day"))
    ).drop("day")
    calendar = t.calendar
    keep, end = c.clip_to_calendar(calendar, "period_start", "period_end", "date_left")
    rows = _counted(hot.filter(keep).withColumn("effective_end", end), calendar, ["org"], "period_start", "effective_end")
    plain = overlap_periods(hot, calendar, extra_end="date_left").groupBy("month_no").count()
    assert {r["month_no"]: r["copies"] for r in rows.collect()} == {r["month_no"]: r["count"] for r in plain.collect()}
    wide = replace(t, practice=t.practice.unionByName(hot))
    assert c.population_cells(wide).agg(F.sum("persons")).first()[0] >= c.population_cells(t).agg(F.sum("persons")).first()[0]


def test_one_pass_equals_linked_tables(spark, sf_dir):
    t = patient_tables(spark, sf_dir)
    both = c.link_cells(c.population_cells(t), c.activity_cells(t))
    assert key_rows(both) == key_rows(stored_cells(spark, sf_dir))


def test_repeated_registrations_multiply_events(spark, sf_dir):
    t = patient_tables(spark, sf_dir, calendar=months(spark))
    twice = replace(t, practice=t.practice.unionAll(t.practice))
    total = F.sum("attends")
    assert c.activity_cells(t).agg(total).first()[0] == 58
    assert c.activity_cells(twice).agg(total).first()[0] == 116
    assert c.activity_cells(twice, distinct_events=True).agg(total).first()[0] == 58
    assert key_rows(c.population_cells(twice)) == key_rows(c.population_cells(t))


def test_zero_fill_and_coarser_keys(spark):
    linked = spark.createDataFrame([("a", 10, None), ("a", 5, 2), ("b", 3, None)], "k string, persons int, attends int")
    plain = {r["k"]: r["attends"] for r in c.sum_cells(linked, ["k"]).collect()}
    filled = {r["k"]: r["attends"] for r in c.sum_cells(linked, ["k"], zero_fill=True).collect()}
    assert plain == {"a": 2, "b": None} and filled == {"a": 2, "b": 0}
    population = spark.createDataFrame([("a", 1, 10), ("a", 2, 20)], "k string, fine int, persons int")
    activity = spark.createDataFrame([("a", 1, 3), ("a", 2, 4)], "k string, fine int, attends int")
    row = c.link_cells_on(population, activity, ["k"]).first()
    assert (row["persons"], row["attends"]) == (30, 7)


def test_lookup_tells_unmatched_from_null(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "lsoa string")
    lookup = spark.createDataFrame([("a", 3), ("b", None)], "lsoa string, q int")
    got = assign_lookup(df, lookup, "lsoa", "q", "quintile", 99).collect()
    assert {r["lsoa"]: r["quintile"] for r in got} == {"a": 3, "b": None, "c": 99}
    twice = spark.createDataFrame([("a", 3), ("a", 4)], "lsoa string, q int")
    with pytest.raises(Exception, match="repeated in the lookup"):
        unique_lookup(twice, "lsoa", "q").collect()


def test_codes_stand_for_attribute_sets(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, None, "x")], "k int, a string, b string")
    keys, names = compact_codes(df, "k", ["a", "b"], "code")
    assert keys.select("code").distinct().count() == 2
    assert sorted(map(repr, names.select("a", "b").collect())) == sorted(
        ["Row(a='x', b=None)", "Row(a=None, b='x')"]
    )


def test_broadcast_only_when_small(spark):
    small, large = broadcast_checked(spark.range(5), spark.range(50), limit=100)
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(small) and not hint(large)
    wide = spark.range(5).select(F.repeat(F.lit("x"), 30).alias("name"))
    assert not hint(broadcast_checked(wide, limit=100)[0])


def test_membership_tables_are_shuffled_once(spark, sf_dir):
    cells = c.rate_cells(patient_tables(spark, sf_dir))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cells.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan
    by_person = [line for line in plan.splitlines() if "Exchange hashpartitioning(patient#" in line]
    # Three memberships and the events, counted before they move; the joins on
    # (patient, month_no) add none, and no row is compared with windows.
    moved = [line for line in by_person if "REPARTITION_BY_COL" in line]
    counted = [line for line in by_person if "first#" in line and "last#" in line]
    assert len(moved) == len(counted) == 4 and len(by_person) == 8
    assert "NestedLoopJoin" not in plan
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    for column in ("date_left#", "dob#", "date_detected_end#", "episode_start#"):
        assert sum(column in line for line in scans) == 1


def test_scan_filters_reach_parquet(spark, sf_dir):
    tables = patient_tables(spark, sf_dir)
    cells, last = c.rate_cells(tables), tables.calendar.last
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = cells._jdf.queryExecution().explainString(formatted)
    assert "EqualTo(source,7)" in plan and "EqualTo(episode_number,1)" in plan
    assert "StringStartsWith(method,1)" in plan and f"LessThan(period_start,{last})" in plan
    assert f"LessThan(episode_start,{last})" in plan
