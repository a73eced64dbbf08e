"""Cells from changes beside cells from rows per person and window."""

from datetime import date
from functools import reduce

import pytest
from pyspark.sql import functions as F

from checks.derived import derived_tables, outcomes, patient_tables
from ratelab.operators.cells import CELL_KEYS, rate_cells
from ratelab.operators.changes import cells_by_changes
from ratelab.plans import study
from ratelab.sources.calendar import from_table, rolling, spanning


def rows(df, *columns):
    return sorted(df.select(*columns).collect(), key=repr)


@pytest.mark.parametrize("width", [1, 3, 12])
def test_equals_rows_per_window(spark, sf_dir, width):
    events = derived_tables(spark, sf_dir)["encounter"]
    tables = patient_tables(spark, sf_dir, calendar=spanning(events, "episode_start", width))
    columns = [*CELL_KEYS, "persons", "attends"]
    assert rows(cells_by_changes(tables), *columns) == rows(rate_cells(tables), *columns)


def test_outcomes_side_by_side_as_alone(spark, sf_dir):
    tables = patient_tables(spark, sf_dir, calendar=rolling(spark, date(1995, 1, 1), 14, 6))
    both = cells_by_changes(tables, outcomes())
    for name, rule in outcomes().items():
        alone = cells_by_changes(tables, {name: rule})
        assert rows(both, *CELL_KEYS, "persons", name) == rows(alone, *CELL_KEYS, "persons", name)
    total = both.agg(*[F.sum(name) for name in outcomes()]).first()
    assert 0 < total[1] < total[0]


def test_repeated_memberships_and_other_columns(spark, sf_dir):
    """Copies multiply events, never people, whatever ranges they cover; clashing columns are not read."""
    from dataclasses import replace

    tables = patient_tables(spark, sf_dir, calendar=rolling(spark, date(1995, 6, 1), 8, 2))
    later = tables.practice.withColumn("period_start", F.greatest("period_start", F.lit(date(1995, 9, 5))))
    copies = reduce(lambda a, b: a.unionAll(b), [tables.practice, tables.practice, later])
    odd = replace(tables, practice=copies.withColumn("at", F.lit(1)).withColumn("first", F.lit("x")))
    columns = [*CELL_KEYS, "persons", "attends"]
    assert rows(cells_by_changes(odd), *columns) == rows(rate_cells(odd), *columns)
    assert cells_by_changes(replace(tables, practice=tables.practice.limit(0))).count() == 0


def test_refused(spark, sf_dir):
    tables = patient_tables(spark, sf_dir)
    with pytest.raises(ValueError, match="not a name"):
        cells_by_changes(tables, {"persons": F.lit(True)})
    from dataclasses import replace

    with pytest.raises(ValueError, match="equal windows"):
        cells_by_changes(replace(tables, calendar=from_table(tables.calendar.periods)))


def test_specifications_read_their_own_table(spark, sf_dir):
    tables = patient_tables(spark, sf_dir, calendar=rolling(spark, date(1995, 1, 1), 12, 1))
    cells = cells_by_changes(tables, outcomes()).cache()
    data = study.model_tables(cells, cells.filter("month_no > 6"))
    assert {s.data for s in study.SPECIFICATIONS.values()} == set(data)
    assert data["monthly"].filter("admits IS NULL OR attends IS NULL").count() == 0
    assert data["collapsed"].agg(F.sum("admits")).first() == data["monthly"].agg(F.sum("admits")).first()
    assert data["yearly"].agg(F.min("month_no")).first()[0] > 6 and "month_no" not in data["collapsed"].columns
    table = study.run_specification(study.SPECIFICATIONS["collapsed_poisson"], data)
    assert "deprived" in [r["term"] for r in table.collect()]
