"""Patient-level tables derived from the test tables.

The text runs unchanged in Spark and DuckDB. Every customer has a practice,
profile and residence membership and every order is an event; the further
members of each UNION add second registrations, moves and rows of another
source, and drop nothing. Small dimensions are the distinct codes the
memberships use; one area is left out of the deprivation index on purpose.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession

from ratelab.operators.cells import PatientTables, Rules, event_rule, rate_cells, study_strata
from ratelab.operators.changes import cells_by_changes
from ratelab.scratch import Scratch
from ratelab.sources.calendar import Calendar, spanning

ASOF = date(1996, 7, 1)

TABLES = {
    "fact_practice": """
SELECT c_custkey AS patient, c_custkey % 40 AS org, 7 AS source,
 DATE '1993-01-01' + CAST(c_custkey*37 % 900 AS INT) AS period_start,
 CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 5 < 3 THEN DATE '9999-12-31'
      ELSE DATE '1994-06-01' + CAST(c_custkey*53 % 900 AS INT) END AS period_end,
 CASE WHEN c_custkey % 7 = 0 THEN DATE '1995-10-15' END AS date_left FROM customer
UNION ALL SELECT c_custkey, (c_custkey+1) % 40, 7, DATE '1995-09-20', DATE '9999-12-31', CAST(NULL AS DATE)
 FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT c_custkey, c_custkey % 40, 8, DATE '1993-01-01', DATE '9999-12-31', CAST(NULL AS DATE)
 FROM customer WHERE c_custkey % 3 = 0""",
    "fact_profile": """
SELECT c_custkey AS patient, 7 AS source, c_custkey % 10 AS gender_sk,
 DATE '1888-01-01' + CAST(c_custkey*7919 % 39000 AS INT) AS dob,
 DATE '1990-01-01' AS period_start, DATE '9999-12-31' AS period_end,
 CASE WHEN c_custkey % 13 = 0 THEN DATE '1995-08-20' END AS date_of_death FROM customer""",
    "fact_residence": """
SELECT c_custkey AS patient, 7 AS source, c_custkey % 60 AS area_sk, DATE '1992-01-01' AS period_start,
 CASE WHEN c_custkey % 4 = 0 THEN DATE '1995-09-10' ELSE DATE '9999-12-31' END AS period_end,
 CASE WHEN c_custkey % 9 = 0 THEN DATE '1996-02-10' END AS date_detected_end FROM customer
UNION ALL SELECT c_custkey, 7, (c_custkey+7) % 60, DATE '1995-09-15', DATE '9999-12-31', CAST(NULL AS DATE)
 FROM customer WHERE c_custkey % 4 = 0""",
    "gender": """
SELECT DISTINCT c_custkey % 10 AS gender_sk,
 CASE WHEN c_custkey % 10 = 9 THEN 'U' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM customer""",
    "output_area": """
SELECT DISTINCT c_custkey % 60 AS area_sk, concat('E', CAST(1000 + c_custkey % 60 AS VARCHAR(8))) AS lsoa,
 CASE WHEN c_custkey % 60 = 59 THEN '2021' ELSE '2011' END AS census_year FROM customer""",
    "organisation": """
SELECT DISTINCT c_custkey % 100 AS org, concat('P', CAST(c_custkey % 100 AS VARCHAR(8))) AS org_code,
 CASE WHEN c_custkey % 100 = 39 THEN NULL ELSE c_custkey % 5 + 50 END AS parent_org FROM customer""",
    "pcn": """
SELECT o.org_code AS practice_code, concat('Practice ', o.org_code) AS practice_name, n.n_name AS pcn_name,
 CASE WHEN o.org = 38 THEN '' ELSE r.r_name END AS borough
FROM organisation o JOIN nation n ON n.n_nationkey = o.org % 10 JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE o.org IN (SELECT org FROM fact_practice)""",
    "imd": """
SELECT lsoa, CASE WHEN area_sk = 57 THEN NULL ELSE CAST(area_sk % 5 + 1 AS INT) END AS imd_quintile
FROM output_area WHERE area_sk <> 58""",
    "encounter": """
SELECT o_orderkey AS encounter, o_custkey AS patient, CAST(o_orderdate AS DATE) AS episode_start,
 o_orderpriority AS method, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS episode_number FROM orders""",
}

BASE = ["customer", "orders", "nation", "region"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: dict[tuple[str, str], dict[str, DataFrame]] = {}


def derived_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived tables, written by Spark once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        _WRITTEN[key] = _derive(spark, sf_dir, Scratch(spark))
    return _WRITTEN[key]


def _derive(spark: SparkSession, sf_dir: str, scratch: Scratch) -> dict[str, DataFrame]:
    known = {name: load(spark, sf_dir, name) for name in BASE}
    out: dict[str, DataFrame] = {}
    for name, text in TABLES.items():
        known[name] = out[name] = scratch.keep(_table(spark, text, known), name)
    return out


def _table(spark: SparkSession, text: str, known: dict[str, DataFrame]) -> DataFrame:
    """What the text selects, its names bound to the ``known`` frames.

    A list of IN is bound to its distinct values: else every row of the list
    moves, to the task of its value.
    """
    frames = dict(known)
    for column, table in set(re.findall(r"\bIN \(SELECT (\w+) FROM (\w+)\)", text)):
        values = f"{table}_{column}"
        frames[values] = known[table].select(column).distinct()
        text = text.replace(f"IN (SELECT {column} FROM {table})", f"IN (SELECT {column} FROM {values})")
    for name in frames:
        text = _bind(text, name)
    # Braced names are bound to these frames, not to session views.
    return spark.sql(text, **{t: df for t, df in frames.items() if f"{{{t}}}" in text})


def _bind(text: str, table: str) -> str:
    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)


_CALENDARS: dict[tuple[str, str], Calendar] = {}


def event_calendar(spark: SparkSession, sf_dir: str) -> Calendar:
    """Every month that has an event."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CALENDARS:
        _CALENDARS[key] = spanning(derived_tables(spark, sf_dir)["encounter"], "episode_start")
    return _CALENDARS[key]


def patient_tables(spark: SparkSession, sf_dir: str, **options) -> PatientTables:
    d = derived_tables(spark, sf_dir)
    return PatientTables(
        practice=d["fact_practice"],
        profile=d["fact_profile"],
        residence=d["fact_residence"],
        gender=d["gender"],
        output_area=d["output_area"],
        organisation=d["organisation"],
        pcn=d["pcn"],
        imd=d["imd"],
        encounter=d["encounter"],
        calendar=options.pop("calendar", None) or event_calendar(spark, sf_dir),
        asof=ASOF,
        **options,
    )


_CELLS: dict[tuple[str, str], DataFrame] = {}


def stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked population and activity cells, built once and read back as a table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CELLS:
        cells = rate_cells(patient_tables(spark, sf_dir))
        # By period, so that reports on one read only its part; a period too
        # large for a file is split.
        _CELLS[key] = Scratch(spark).keep(cells.hint("rebalance", "month_no"), "cells", "month_no", "month")
    return _CELLS[key]


def study_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_strata(stored_cells(spark, sf_dir))


def ctes(*extra: str) -> str:
    """WITH clause holding the derived tables and the literal cell queries."""
    parts = [f"{name} AS ({text})" for name, text in {**TABLES, **CELLS}.items()]
    return "WITH RECURSIVE " + ",\n".join([*parts, *extra]) + "\n"


# The SQL works on sets of (person, month): per table the months it covers a
# person in, by counting months, then the overlap of the three sets.
def _month(day: str) -> str:
    return f"12 * (year({day}) - y0) + month({day}) - m0 + 1"


def _covered(start: str, end: str, extra_end: str) -> str:
    """Months that an interval covers, within the calendar."""
    stop = f"least({end}, coalesce({extra_end}, {end}))"
    return f"unnest(range(greatest({_month(start)}, 1), least({_month(stop)}, months) + 1))"


_CELL = "month_no, lsoa, borough, pcn_name, practice_code, practice_name, age_band, gender"


def _named(cells: str, measure: str) -> str:
    """Cells with the period's date and the area's quintile."""
    return f"""
SELECT c.month, c.month_no, lsoa, borough, pcn_name, practice_code, practice_name, q.quintile, age_band, gender, {measure}
FROM {cells} JOIN calendar c USING (month_no) JOIN area_quintile q USING (lsoa)"""


CELLS = {
    "span": """
SELECT *, 12 * (year(hi) - y0) + month(hi) - m0 + 1 AS months FROM
 (SELECT year(min(episode_start)) AS y0, month(min(episode_start)) AS m0, max(episode_start) AS hi FROM encounter)""",
    "calendar": """
SELECT CAST(d AS DATE) AS month, CAST(k + 1 AS INT) AS month_no, CAST(d AS DATE) AS start_date,
 CAST(d + INTERVAL 1 MONTH AS DATE) AS end_date
FROM (SELECT k, make_date(y0, m0, 1) + to_months(CAST(k AS INT)) AS d FROM (SELECT y0, m0, unnest(range(months)) AS k FROM span))""",
    "area_quintile": """
SELECT lsoa, CASE WHEN lsoa IN (SELECT lsoa FROM imd) THEN max(imd_quintile) ELSE 99 END AS quintile
FROM output_area LEFT JOIN imd USING (lsoa) GROUP BY lsoa""",
    "at_practice": f"""
SELECT patient, month_no, borough, pcn_name, practice_code, practice_name, count(*) AS times FROM
 (SELECT patient, org, {_covered('period_start', 'period_end', 'date_left')} AS month_no
  FROM fact_practice, span WHERE source = 7 AND period_end IS NOT NULL)
 JOIN organisation USING (org) JOIN pcn ON practice_code = org_code
WHERE parent_org IN (SELECT org FROM organisation) AND length(trim(borough)) > 0 GROUP BY ALL""",
    "profiled": f"""
SELECT patient, month_no, gender, born // 15 * 15 AS age_band, count(*) AS times FROM
 (SELECT patient, gender_sk, CAST(1996 - year(dob) AS INT) AS born, {_covered('period_start', 'period_end', 'date_of_death')} AS month_no
  FROM fact_profile, span WHERE source = 7 AND period_end IS NOT NULL) JOIN gender USING (gender_sk) GROUP BY ALL""",
    "resident": f"""
SELECT patient, month_no, lsoa, count(*) AS times FROM
 (SELECT patient, area_sk, {_covered('period_start', 'period_end', 'date_detected_end')} AS month_no
  FROM fact_residence, span WHERE source = 7 AND period_end IS NOT NULL) JOIN output_area USING (area_sk) WHERE census_year = '2011' GROUP BY ALL""",
    "attended": f"""
SELECT patient, {_month('episode_start')} AS month_no, count(*) AS visits, count(*) FILTER (starts_with(method, '1')) AS stays FROM encounter, span
WHERE episode_number = 1 AND (starts_with(method, '1') OR starts_with(method, '2')) GROUP BY ALL""",
    "person_month": f"""
SELECT patient, {_CELL}, p.times * f.times * r.times AS times, visits
FROM at_practice p JOIN profiled f USING (patient, month_no) JOIN resident r USING (patient, month_no)
LEFT JOIN attended USING (patient, month_no)""",
    "population_raw": f"""
SELECT {_CELL}, count(DISTINCT patient) AS persons FROM person_month GROUP BY ALL""",
    "population": _named("population_raw", "persons"),
    "activity_raw": f"""
SELECT {_CELL}, CAST(sum(times * visits) AS BIGINT) AS attends, CAST(sum(visits) AS BIGINT) AS distinct_attends
FROM person_month WHERE visits > 0 GROUP BY ALL""",
    "activity": _named("activity_raw", "attends"),
    "linked": """
SELECT p.*, a.attends FROM population p LEFT JOIN (SELECT * EXCLUDE (month) FROM activity) a
USING (month_no, lsoa, borough, pcn_name, practice_code, practice_name, quintile, age_band, gender)""",
    "study": "SELECT * FROM linked WHERE quintile <> 99 AND gender <> 'U' AND age_band < 105",
}


def windows_sql(width: int) -> list[str]:
    """Cells of windows of ``width`` months that start in every month, with two outcomes: ``wide_study``.

    Every membership row of a month counts for each window that holds the month.
    """
    windows = f"unnest(range(greatest(a - {width - 1}, 1), least(b, months) + 1)) AS month_no"

    def touched(columns: str, start: str, end: str, extra: str, source: str) -> str:
        stop = f"least({end}, coalesce({extra}, {end}))"
        return f"""(SELECT patient, {columns}, {windows} FROM (SELECT *, greatest({_month(start)}, 1) AS a, {_month(stop)} AS b
 FROM {source}, span WHERE source = 7 AND period_end IS NOT NULL))"""

    return [
        f"""
wide_practice AS (SELECT patient, month_no, borough, pcn_name, practice_code, practice_name, count(*) AS times
 FROM {touched('org', 'period_start', 'period_end', 'date_left', 'fact_practice')}
 JOIN organisation USING (org) JOIN pcn ON practice_code = org_code
 WHERE parent_org IN (SELECT org FROM organisation) AND length(trim(borough)) > 0 GROUP BY ALL)""",
        f"""
wide_profile AS (SELECT patient, month_no, gender, CAST(1996 - year(dob) AS INT) // 15 * 15 AS age_band, count(*) AS times
 FROM {touched('gender_sk, dob', 'period_start', 'period_end', 'date_of_death', 'fact_profile')} JOIN gender USING (gender_sk) GROUP BY ALL)""",
        f"""
wide_resident AS (SELECT patient, month_no, lsoa, count(*) AS times
 FROM {touched('area_sk', 'period_start', 'period_end', 'date_detected_end', 'fact_residence')}
 JOIN output_area USING (area_sk) WHERE census_year = '2011' GROUP BY ALL)""",
        f"""
wide_events AS (SELECT patient, month_no, sum(visits) AS visits, sum(stays) AS stays FROM
 (SELECT patient, visits, stays, unnest(range(greatest(month_no - {width - 1}, 1), month_no + 1)) AS month_no FROM attended) GROUP BY ALL)""",
        f"""
wide_cells AS (SELECT {_CELL}, count(DISTINCT patient) AS persons, CAST(sum(p.times * f.times * r.times * visits) AS BIGINT) AS attends,
 CAST(sum(p.times * f.times * r.times * stays) AS BIGINT) AS admits
 FROM wide_practice p JOIN wide_profile f USING (patient, month_no) JOIN wide_resident r USING (patient, month_no)
 LEFT JOIN wide_events USING (patient, month_no) GROUP BY ALL)""",
        f"""
wide_named AS ({_named("wide_cells", "persons, CASE WHEN q.quintile IS NOT NULL THEN attends END AS attends, CASE WHEN q.quintile IS NOT NULL THEN nullif(admits, 0) END AS admits")})""",
        """
wide_study AS (SELECT * FROM wide_named WHERE quintile <> 99 AND gender <> 'U' AND age_band < 105)""",
    ]


_WINDOWS: dict[tuple[str, str, int], DataFrame] = {}


def outcomes() -> dict[str, Column]:
    """Two overlapping sets of events of one table."""
    return {"attends": event_rule(Rules()), "admits": event_rule(Rules(method_prefixes=("1",)))}


def window_cells(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """Cells of windows of ``width`` months with two outcomes, built once and read back as a table."""
    key = (spark.sparkContext.applicationId, sf_dir, width)
    if key not in _WINDOWS:
        calendar = spanning(derived_tables(spark, sf_dir)["encounter"], "episode_start", width)
        cells = cells_by_changes(patient_tables(spark, sf_dir, calendar=calendar), outcomes())
        _WINDOWS[key] = Scratch(spark).keep(cells.hint("rebalance", "month_no"), f"cells{width}", "month_no", "month")
    return _WINDOWS[key]
