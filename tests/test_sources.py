from datetime import date

import pytest

from ratelab.scratch import Scratch
from ratelab.sources import tables


def test_sheet_reads_missing_text(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(
        "month,month_no,borough,quintile,age_band,gender,persons,attends\n"
        "2023-07-01,7,North,1,15,F,100,NULL\n2023-07-01,7,North,2,15,M,50,3\n"
    )
    got = tables.read_sheet(spark, str(path), tables.ATTENDANCE_SHEET).collect()
    assert got[0]["attends"] is None and got[1]["attends"] == 3.0
    assert got[0]["month"] == date(2023, 7, 1)


def test_parquet_renames_and_casts(spark, tmp_path):
    path = f"{tmp_path}/gender"
    spark.createDataFrame([(1, "F")], "sk_genderid long, code string").write.parquet(path)
    got = tables.read_table(
        spark, path, tables.SCHEMAS["gender"], {"sk_genderid": "gender_sk", "code": "gender"}
    )
    assert got.dtypes == [("gender_sk", "int"), ("gender", "string")]
    assert tuple(got.first()) == (1, "F")


def test_writes_replace_and_partition(spark, tmp_path):
    path = f"{tmp_path}/cells"
    for n in (1, 2):
        tables.write_table(spark.createDataFrame([(n, 5)], "month_no int, persons int"), path, "month_no")
    assert [r["month_no"] for r in spark.read.parquet(path).collect()] == [2]
    plan = spark.read.parquet(path).filter("month_no = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_no" in plan
    tables.write_sheet(spark.createDataFrame([(1, None)], "a int, b int"), f"{tmp_path}/sheet")
    assert "1,NULL" in "".join(p.read_text() for p in (tmp_path / "sheet").glob("part-*"))


def test_bad_rows_of_a_sheet_are_set_aside(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(
        "month,month_no,borough,quintile,age_band,gender,persons,attends\n"
        "2023-07-01,7,North,1,15,F,100,NULL\n2023-07-01,seven,North,2,15,M,x,3\n"
        "2023-13-01,7,\"a,b\",,15,M,5,3\n1,2\n2023-07-01,7,North,2,15,M,50,3,extra\n,NULL,,,,,,\n"
    )
    with Scratch(spark) as scratch:
        good, rejected = tables.read_sheet_split(spark, str(path), tables.ATTENDANCE_SHEET, scratch)
        assert good.schema == tables.schema_of(tables.ATTENDANCE_SHEET)
        assert sorted(([r["persons"], r["attends"]] for r in good.collect()), key=repr) == [[100.0, None], [None, None]]
        found = {tuple(r["reasons"]): r for r in rejected.collect()}
        assert set(found) == {
            ("month_no: 'seven' is no double", "persons: 'x' is no double"), ("month: '2023-13-01' is no date",), ("not 8 values",),
        }
        assert rejected.count() == 4 and all(r["file"].endswith("sheet.csv") for r in found.values())
        assert sorted(r["line"] for r in rejected.collect())[0] == "1,2"
        path.write_text("month,month_no,borough,quintile,age_band,gender,persons,attends\n")
    with Scratch(spark) as scratch:
        assert [t.count() for t in tables.read_sheet_split(spark, str(path), tables.ATTENDANCE_SHEET, scratch)] == [0, 0]


def test_only_given_periods_are_replaced(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(m, n) for m in (1, 2, 3)], "month_no int, persons int")
    path = f"{tmp_path}/cells"
    tables.write_table(rows(5), path, "month_no")
    tables.replace_periods(rows(9).filter("month_no = 2"), path, "month_no")
    tables.replace_periods(rows(7).limit(0), path, "month_no")
    assert sorted((r["month_no"], r["persons"]) for r in spark.read.parquet(path).collect()) == [(1, 5), (2, 9), (3, 5)]
    spark.sql(f"CREATE TABLE period_cells (persons INT, month_no INT) USING parquet PARTITIONED BY (month_no) LOCATION '{tmp_path}/t'")
    try:
        rows(5).select("persons", "month_no").write.insertInto("period_cells")
        tables.replace_periods(rows(9).filter("month_no = 2"), "period_cells", "month_no")
        assert sorted(tuple(r) for r in spark.table("period_cells").collect()) == [(5, 1), (5, 3), (9, 2)]
    finally:
        tables.drop_table(spark, "period_cells")


def test_tables_are_dropped_and_databases_chosen(spark, tmp_path):
    spark.sql(f"CREATE DATABASE study_db LOCATION '{tmp_path}/db'")
    try:
        tables.use_database(spark, "study_db")
        assert spark.catalog.currentDatabase() == "study_db"
        spark.sql("CREATE TABLE gone (x INT) USING parquet")
        tables.drop_table(spark, "gone")
        tables.drop_table(spark, "gone")
        assert not spark.catalog.tableExists("gone")
    finally:
        tables.use_database(spark, "default")
        spark.sql("DROP DATABASE study_db CASCADE")


def test_query_options(monkeypatch):
    monkeypatch.delenv("WAREHOUSE_URL", raising=False)
    with pytest.raises(KeyError):
        tables.query_options("WAREHOUSE_URL", "SELECT 1")
    monkeypatch.setenv("WAREHOUSE_URL", "jdbc:x")
    assert tables.query_options("WAREHOUSE_URL", "SELECT 1") == {"url": "jdbc:x", "query": "SELECT 1"}
    split = tables.query_options("WAREHOUSE_URL", "SELECT 1", "id", (0, 9), 4)
    assert split["dbtable"] == "(SELECT 1) q" and split["numPartitions"] == "4"
    with pytest.raises(ValueError):
        tables.query_options("WAREHOUSE_URL", "SELECT 1", "id")


def test_scratch_tables_cut_lineage_and_clear(spark):
    with Scratch(spark) as scratch:
        kept = scratch.keep(spark.range(5).selectExpr("id", "id * 2 AS x"), "t")
        assert kept.count() == 5
        assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()
        path = scratch.path
    with pytest.raises(Exception):
        spark.read.parquet(f"{path}/t")
