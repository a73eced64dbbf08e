"""Calendars, memberships, cells, rates and checks, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.derived import (
    _named, derived_tables, event_calendar, patient_tables, stored_cells, study_cells, window_cells, windows_sql,
)
from checks.registry import query, rounded
from ratelab.operators import filters, quality
from ratelab.operators.cells import (
    CELL_KEYS,
    PLACE,
    activity_cells,
    population_cells,
    practice_places,
    rate_cells,
    sum_cells,
)
from ratelab.operators.lookup import assign_lookup
from ratelab.operators.membership import events_in_periods, overlap_periods
from ratelab.operators.rates import rate_table
from ratelab.plans import study
from ratelab.scratch import Scratch
from ratelab.sources import tables
from ratelab.sources.calendar import spanning

# --- calendars and memberships ------------------------------------------------

_MONTHS = """
months AS (SELECT CAST(d AS DATE) AS month, CAST(row_number() OVER (ORDER BY d) AS INT) AS month_no
 FROM (SELECT unnest(generate_series(date_trunc('month', min(episode_start))::TIMESTAMP,
  date_trunc('month', max(episode_start))::TIMESTAMP, INTERVAL 1 MONTH)) AS d FROM encounter))"""


def _window_events(spark, sf_dir, width):
    events = derived_tables(spark, sf_dir)["encounter"]
    calendar = spanning(events, "episode_start", width)
    counts = quality.rows_per(events_in_periods(events, calendar, "episode_start"), "month_no")
    return calendar.periods.join(counts, "month_no", "left")


def _window_sql(width):
    return f"""
SELECT m.month, m.month_no, m.month AS start_date, CAST(m.month + INTERVAL {width} MONTH AS DATE) AS end_date,
 count(*) AS n FROM months m JOIN encounter e
 ON e.episode_start >= m.month AND e.episode_start < m.month + INTERVAL {width} MONTH GROUP BY ALL"""


@query("calendar_monthly", _window_sql(1), _MONTHS)
def calendar_monthly(spark, sf_dir):
    return _window_events(spark, sf_dir, 1)


@query("calendar_rolling3", _window_sql(3), _MONTHS)
def calendar_rolling3(spark, sf_dir):
    return _window_events(spark, sf_dir, 3)


@query(
    "membership_overlap",
    """
SELECT c.month_no, f.org, count(*) AS memberships, count(DISTINCT f.patient) AS persons
FROM calendar c JOIN fact_practice f ON f.period_start < c.end_date AND f.period_end >= c.start_date
 AND (f.date_left >= c.start_date OR f.date_left IS NULL)
GROUP BY ALL""",
)
def membership_overlap(spark, sf_dir):
    t = patient_tables(spark, sf_dir)
    # Each person once per period and practice, then plain counts.
    people = overlap_periods(t.practice, t.calendar, extra_end="date_left", per=["patient", "org"])
    return people.groupBy("month_no", "org").agg(
        F.sum("copies").alias("memberships"), F.count(F.lit(1)).alias("persons")
    )


@query(
    "parent_org_join",
    """
SELECT org1.org, pcn.borough, pcn.pcn_name, pcn.practice_code, pcn.practice_name, count(DISTINCT f.patient) AS persons
FROM organisation org1 JOIN organisation org2 ON org1.parent_org = org2.org
JOIN pcn ON org1.org_code = pcn.practice_code JOIN fact_practice f ON f.org = org1.org
WHERE trim(pcn.borough) <> '' GROUP BY ALL""",
)
def parent_org_join(spark, sf_dir):
    t = patient_tables(spark, sf_dir)
    places = practice_places(t.organisation, t.pcn)
    return t.practice.join(places, "org").groupBy("org", *PLACE).agg(F.count_distinct("patient").alias("persons"))


# --- cells --------------------------------------------------------------------


@query("population_cells", "SELECT * FROM population")
def population(spark, sf_dir):
    return population_cells(patient_tables(spark, sf_dir))


@query("activity_cells", "SELECT * FROM activity")
def activity(spark, sf_dir):
    return activity_cells(patient_tables(spark, sf_dir))


@query(
    "activity_cells_distinct_events",
    _named("activity_raw", "distinct_attends AS attends"),
)
def activity_distinct(spark, sf_dir):
    return activity_cells(patient_tables(spark, sf_dir), distinct_events=True)


@query("rate_cells", "SELECT * FROM linked")
def linked(spark, sf_dir):
    return rate_cells(patient_tables(spark, sf_dir))


@query("rolling_year_cells", "SELECT * FROM wide_named", *windows_sql(12))
def rolling_year_cells(spark, sf_dir):
    return window_cells(spark, sf_dir, 12)


@query("monthly_outcome_cells", "SELECT * FROM wide_named", *windows_sql(1))
def monthly_outcome_cells(spark, sf_dir):
    return window_cells(spark, sf_dir, 1)


@query(
    "assign_quintile",
    """
SELECT lsoa, quintile, count(*) AS cells, CAST(sum(persons) AS BIGINT) AS persons
FROM population_raw JOIN area_quintile USING (lsoa) GROUP BY ALL""",
)
def assign_quintile(spark, sf_dir):
    cells = stored_cells(spark, sf_dir).drop("quintile")
    areas = cells.groupBy("lsoa").agg(F.count(F.lit(1)).alias("cells"), F.sum("persons").alias("persons"))
    imd = derived_tables(spark, sf_dir)["imd"]
    return assign_lookup(areas, imd, "lsoa", "imd_quintile", "quintile", 99)


@query(
    "cells_latest_period",
    """
SELECT borough, pcn_name, practice_code, practice_name, quintile, age_band, gender,
 CAST(sum(persons) AS BIGINT) AS persons, CAST(sum(attends) AS BIGINT) AS attends
FROM study WHERE month_no = (SELECT max(month_no) FROM calendar) GROUP BY ALL""",
)
def cells_latest_period(spark, sf_dir):
    return study.latest_report(stored_cells(spark, sf_dir), event_calendar(spark, sf_dir).count)


_PERIOD_TABLE = """
period_table AS (SELECT month, month_no, borough, pcn_name, practice_code, practice_name, quintile, age_band, gender,
 CAST(sum(persons) AS BIGINT) AS persons, CAST(coalesce(sum(attends), 0) AS BIGINT) AS attends
 FROM study GROUP BY ALL)"""


@query("cells_by_period_zero_filled", "SELECT * FROM period_table", _PERIOD_TABLE)
def cells_by_period(spark, sf_dir):
    return study.attendance_table(stored_cells(spark, sf_dir))


@query(
    "cells_collapsed_zero_filled",
    """
SELECT borough, pcn_name, practice_code, practice_name, quintile, age_band, gender,
 CAST(sum(persons) AS BIGINT) AS persons, CAST(coalesce(sum(attends), 0) AS BIGINT) AS admits
FROM study GROUP BY ALL""",
)
def cells_collapsed(spark, sf_dir):
    cells = stored_cells(spark, sf_dir).withColumnRenamed("attends", "admits")
    return study.admission_table(cells)


_BOROUGH_TABLE = """
borough_table AS (
SELECT p.*, a.attends FROM
 (SELECT month, month_no, borough, quintile, age_band, gender, CAST(sum(persons) AS BIGINT) AS persons
  FROM population WHERE quintile <> 99 AND gender <> 'U' AND age_band < 105 GROUP BY ALL) p
LEFT JOIN
 (SELECT month, month_no, borough, quintile, age_band, gender, CAST(sum(attends) AS BIGINT) AS attends
  FROM activity GROUP BY ALL) a USING (month, month_no, borough, quintile, age_band, gender))"""


def _borough(spark, sf_dir):
    cells = stored_cells(spark, sf_dir)
    events = cells.filter(F.col("attends").isNotNull()).select(*CELL_KEYS, "attends")
    return study.borough_table(cells, events)


@query("cells_by_borough_preagg", "SELECT * FROM borough_table", _BOROUGH_TABLE)
def cells_by_borough(spark, sf_dir):
    return _borough(spark, sf_dir)


# --- rates and checks ---------------------------------------------------------


def _wilson_sql(group: str, source: str, divisor: int = 1) -> str:
    """Limits as the two rates that a score test just does not reject, by bisection."""
    over = f" / {divisor}.0" if divisor != 1 else ""
    kind = "DOUBLE" if divisor != 1 else "BIGINT"
    beyond = "(attends - persons * mid) ** 2 > 3.8414588206941236 * persons * mid * (1 - mid)"
    return f"""
SELECT g AS {group}, max(persons) AS persons, max(attends) AS attends, round(max(attends / persons), 6) AS prop,
 round(max(inner_end) FILTER (side = 0), 6) AS lcl, round(max(inner_end) FILTER (side = 1), 6) AS ucl
FROM (
 WITH RECURSIVE rate AS (SELECT {group} AS g, CAST(sum(persons){over} AS {kind}) AS persons,
   CAST(coalesce(sum(attends), 0){over} AS {kind}) AS attends FROM {source} GROUP BY {group}),
 search AS (SELECT 0 AS k, g, persons, attends, side, CAST(side AS DOUBLE) AS outer_end, attends / persons AS inner_end
   FROM rate, (VALUES (0), (1)) AS v(side)
  UNION ALL SELECT k + 1, g, persons, attends, side,
   CASE WHEN {beyond} THEN mid ELSE outer_end END, CASE WHEN {beyond} THEN inner_end ELSE mid END
  FROM (SELECT *, (outer_end + inner_end) / 2 AS mid FROM search WHERE k < 60))
 SELECT * FROM search WHERE k = 60) GROUP BY g"""


@query("rate_by_quintile_wilson", _wilson_sql("quintile", "study"))
def rate_by_quintile(spark, sf_dir):
    return rounded(rate_table(study_cells(spark, sf_dir), ["quintile"]), "prop", "lcl", "ucl")


@query(
    "rate_by_quintile_div12",
    "SELECT quintile, round(persons, 6) AS persons, round(attends, 6) AS attends, prop, lcl, ucl FROM ("
    + _wilson_sql("quintile", "study", 12)
    + ")",
)
def rate_by_quintile_div12(spark, sf_dir):
    table = rate_table(study_cells(spark, sf_dir), ["quintile"], divisor=12)
    return rounded(table, "persons", "attends", "prop", "lcl", "ucl")


@query("rate_by_practice_wilson", _wilson_sql("practice_code", "study"))
def rate_by_practice(spark, sf_dir):
    return rounded(rate_table(study_cells(spark, sf_dir), ["practice_code"]), "prop", "lcl", "ucl")


def _exposure_sql(below: int, name: str) -> str:
    return f"""
SELECT CASE WHEN quintile < {below} THEN 1 WHEN quintile >= {below} THEN 0 END AS {name}, count(*) AS cells,
 CAST(sum(persons) AS BIGINT) AS persons, CAST(sum(attends) AS BIGINT) AS attends FROM linked GROUP BY 1"""


def _exposed(spark, sf_dir, name):
    return study.features(stored_cells(spark, sf_dir)).groupBy(name).agg(
        F.count(F.lit(1)).alias("cells"), F.sum("persons").alias("persons"), F.sum("attends").alias("attends")
    )


@query("exposure_q1", _exposure_sql(2, "deprived"))
def exposure_q1(spark, sf_dir):
    return _exposed(spark, sf_dir, "deprived")


@query("exposure_q12", _exposure_sql(3, "deprived2"))
def exposure_q12(spark, sf_dir):
    return _exposed(spark, sf_dir, "deprived2")


@query(
    "age_totals_strict",
    """
SELECT age_band, CAST(sum(persons) AS BIGINT) AS persons,
 CASE WHEN count(*) = count(attends) THEN CAST(sum(attends) AS BIGINT) END AS attends
FROM (SELECT age_band, quintile, gender, sum(persons) AS persons, sum(attends) AS attends
 FROM linked GROUP BY ALL) GROUP BY age_band""",
)
def age_totals_strict(spark, sf_dir):
    table = sum_cells(stored_cells(spark, sf_dir), ["age_band", "quintile", "gender"])
    return quality.strict_totals(table, ["age_band"], "persons", "attends")


@query("date_range", "SELECT min(month) AS min_month, max(month) AS max_month FROM study")
def date_range(spark, sf_dir):
    return quality.value_range(study_cells(spark, sf_dir), "month")


@query("rows_per_period", "SELECT month, count(*) AS n FROM study GROUP BY month")
def rows_per_period(spark, sf_dir):
    return quality.rows_per(study_cells(spark, sf_dir), "month")


@query("period_filter", "SELECT * FROM study WHERE year(month) = 1996 AND month(month) = 7")
def period_filter(spark, sf_dir):
    return filters.keep_month(study_cells(spark, sf_dir), 1996, 7)


@query(
    "period_exclude",
    "SELECT month_no, count(*) AS n FROM study WHERE NOT (year(month) = 1995 AND month(month) = 12) GROUP BY month_no",
)
def period_exclude(spark, sf_dir):
    return quality.rows_per(filters.drop_month(study_cells(spark, sf_dir), 1995, 12), "month_no")


@query("latest_period_filter", "SELECT * FROM study WHERE month = (SELECT max(month) FROM study)")
def latest_period_filter(spark, sf_dir):
    return filters.latest_period(study_cells(spark, sf_dir))


@query(
    "factor_levels",
    """
SELECT 'age_band' AS factor, CAST(age_band AS VARCHAR) AS level FROM study GROUP BY age_band
UNION ALL SELECT 'borough', borough FROM study GROUP BY borough
UNION ALL SELECT 'gender', gender FROM study GROUP BY gender""",
)
def factor_levels(spark, sf_dir):
    cells, out = study_cells(spark, sf_dir), None
    for name in ("age_band", "borough", "gender"):
        levels = quality.factor_levels(cells, name).select(
            F.lit(name).alias("factor"), F.col(name).cast("string").alias("level")
        )
        out = levels if out is None else out.unionByName(levels)
    return out


@query(
    "wide_strata",
    """
SELECT month, label, total FROM (SELECT DISTINCT month FROM one) CROSS JOIN (SELECT DISTINCT label FROM one) LEFT JOIN
 (SELECT month, label, CASE WHEN count(*) = count(attends) THEN CAST(sum(attends) AS BIGINT) END AS total FROM one GROUP BY ALL)
 USING (month, label)""",
    _BOROUGH_TABLE,
    """
one AS (SELECT month, concat_ws('_', age_band, gender, CASE WHEN quintile < 2 THEN 1 ELSE 0 END) AS label, attends
 FROM borough_table WHERE borough = 'AFRICA')""",
)
def wide_strata(spark, sf_dir):
    one = study.features(_borough(spark, sf_dir)).filter(F.col("borough") == "AFRICA")
    wide = quality.wide_strata(one, "month", ["age_band", "gender", "deprived"], "attends")
    # One row per column again: SQL has to name the columns of a wide result.
    return wide.unpivot(["month"], [c for c in wide.columns if c != "month"], "label", "total")


@query(
    "missing_numerator_periods",
    """
SELECT month, borough, practice_code, CAST(sum(persons) AS BIGINT) AS persons FROM study
GROUP BY ALL HAVING coalesce(sum(attends), 0) = 0 AND sum(persons) > 0""",
)
def missing_numerator(spark, sf_dir):
    return quality.missing_numerator(study_cells(spark, sf_dir), ["month", "borough", "practice_code"])


@query(
    "periods_without_events",
    """
SELECT month_no, practice_code FROM population WHERE quintile <> 99 AND gender <> 'U' AND age_band < 105 GROUP BY ALL
EXCEPT SELECT month_no, practice_code FROM activity WHERE quintile <> 99 AND gender <> 'U' AND age_band < 105""",
)
def periods_without_events(spark, sf_dir):
    cells = study_cells(spark, sf_dir)
    events = cells.filter(F.col("attends").isNotNull())
    return quality.periods_without_events(cells, events, "month_no", "practice_code")


# --- sheets and rebuilt periods ---------------------------------------------------

_SHEET = """
sheet AS (SELECT month, month_no, borough, quintile, age_band, gender, CAST(sum(persons) AS BIGINT) AS persons,
 CAST(sum(attends) AS BIGINT) AS attends, month_no % 7 = 0 AND gender = 'F' AND quintile = 1 AS bad FROM study
 GROUP BY month, month_no, borough, quintile, age_band, gender)"""


@query(
    "sheet_round_trip",
    """
SELECT borough, count(*) AS n, CAST(sum(persons) AS BIGINT) AS persons, CAST(sum(attends) AS BIGINT) AS attends,
 count(*) FILTER (attends IS NULL) AS missing, 'fits' AS reason FROM sheet WHERE NOT bad GROUP BY borough
UNION ALL SELECT NULL, count(*), NULL, NULL, NULL, 'persons: ''unknown'' is no double' FROM sheet WHERE bad HAVING count(*) > 0""",
    _SHEET,
)
def sheet_round_trip(spark, sf_dir):
    """Write the attendance sheet, some values spoilt, and read it with its rejected rows aside."""
    schema = tables.schema_of(tables.ATTENDANCE_SHEET)
    rows = sum_cells(study_cells(spark, sf_dir), ["month", "month_no", "borough", "quintile", "age_band", "gender"])
    bad = (F.col("month_no") % 7 == 0) & (F.col("gender") == "F") & (F.col("quintile") == 1)
    rows = rows.withColumn("persons", F.when(bad, F.lit("unknown")).otherwise(F.col("persons").cast("string")))
    scratch = Scratch(spark)
    tables.write_sheet(rows.select(*schema.names), scratch.table("attendance_sheet"))
    good, rejected = tables.read_sheet_split(spark, scratch.table("attendance_sheet"), tables.ATTENDANCE_SHEET, scratch)
    fits = good.groupBy("borough").agg(
        F.count(F.lit(1)).alias("n"), F.sum("persons").cast("long").alias("persons"), F.sum("attends").cast("long").alias("attends"),
        F.count_if(F.col("attends").isNull()).alias("missing"), F.lit("fits").alias("reason"),
    )
    out = rejected.groupBy(F.array_join("reasons", "; ").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return fits.unionByName(out, allowMissingColumns=True)


@query(
    "rebuilt_periods",
    """
SELECT month_no, count(*) AS n, CAST(sum(CASE WHEN month_no % 5 = 0 THEN 2 ELSE 1 END * persons) AS BIGINT) AS persons
FROM study GROUP BY month_no""",
)
def rebuilt_periods(spark, sf_dir):
    """Write all periods, then write every fifth again with other numbers."""
    cells, target = study_cells(spark, sf_dir), Scratch(spark).table("periods")
    tables.write_table(cells, target, "month_no")
    again = cells.filter(F.col("month_no") % 5 == 0).withColumn("persons", 2 * F.col("persons"))
    tables.replace_periods(again, target, "month_no")
    stored = spark.read.schema(cells.schema).parquet(target)
    return stored.groupBy("month_no").agg(F.count(F.lit(1)).alias("n"), F.sum("persons").alias("persons"))
