"""Readers and writers. Sheets and tables with a declared schema are checked or cast to it; parquet otherwise keeps its own."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ratelab.scratch import Scratch

SCHEMAS = {
    "practice": "patient long, org long, source int, period_start date, period_end date, date_left date",
    "profile": "patient long, source int, gender_sk int, dob date, period_start date, "
    "period_end date, date_of_death date",
    "residence": "patient long, source int, area_sk long, period_start date, period_end date, "
    "date_detected_end date",
    "gender": "gender_sk int, gender string",
    "output_area": "area_sk long, lsoa string, census_year string",
    "organisation": "org long, org_code string, parent_org long",
    "pcn": "practice_code string, practice_name string, pcn_name string, borough string",
    "imd": "lsoa string, imd_quintile int",
    "encounter": "encounter long, patient long, episode_start date, method string, episode_number int",
    "calendar": "month date, month_no int, start_date date, end_date date",
}

# Column order of the two exported sheets (one row per stratum).
ATTENDANCE_SHEET = (
    "month date, month_no double, borough string, quintile double, age_band double, "
    "gender string, persons double, attends double"
)
ADMISSION_SHEET = (
    "quintile double, age_band double, gender string, borough string, month date, "
    "persons double, attends double, admits double"
)


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def read_table(
    spark: SparkSession,
    source: str,
    schema: str | None = None,
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read a parquet path, or a catalog table when ``source`` has no slash.

    ``rename`` maps stored column names to the names the operators use.
    """
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    df = df.withColumnsRenamed(dict(rename or {}))
    if schema:
        df = df.select(*[df[f.name].cast(f.dataType) for f in schema_of(schema).fields])
    return df


def read_sheet(spark: SparkSession, path: str, schema: str, missing: str = "NULL") -> DataFrame:
    """Read an exported sheet saved as CSV; the text ``missing`` marks an empty value."""
    return (
        spark.read.schema(schema_of(schema))
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", missing)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_sheet_split(
    spark: SparkSession, path: str, schema: str, scratch: Scratch, missing: str = "NULL"
) -> tuple[DataFrame, DataFrame]:
    """Rows of a sheet that fit ``schema``, and the others with the reasons why they do not.

    The second table has ``file``, ``line`` (the text of the row) and
    ``reasons``, one per value that is no number or date of its column, or one
    for a wrong number of values. Lines are read once and stored, so that the
    two tables are parts of the same rows. Empty values and the text
    ``missing`` are null and fit any column.
    """
    fields = schema_of(schema).fields
    bad = "not_of_the_sheet"
    texts = StructType([StructField(f.name, StringType()) for f in fields] + [StructField(bad, StringType())])
    raw = (
        spark.read.schema(texts)
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", missing)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", bad)
        .csv(path)
        .withColumn("file", F.col("_metadata.file_path"))
    )
    wrong = [
        F.when(
            F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(),
            F.format_string(f"{f.name}: '%s' is no {f.dataType.simpleString()}", F.col(f.name)),
        )
        for f in fields
    ]
    count = F.when(F.col(bad).isNotNull(), F.array(F.lit(f"not {len(fields)} values")))
    checked = raw.withColumn("reasons", F.coalesce(count, F.array_compact(F.array(*wrong))))
    checked = scratch.keep(checked, "sheet")
    fits = F.size("reasons") == 0
    line = F.coalesce(bad, F.array_join(F.array(*[F.col(f.name) for f in fields]), ",", missing))
    good = checked.filter(fits).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    return good, checked.filter(~fits).select("file", line.alias("line"), "reasons")


def query_options(
    url_variable: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int | None = None,
) -> dict[str, str]:
    """Options for a database read; the address comes from an environment variable.

    Without a partition column one task reads the whole result, so name one,
    with its bounds, for anything that is not already a small aggregate.
    """
    url = os.environ.get(url_variable)
    if not url:
        raise KeyError(f"environment variable {url_variable} is not set")
    if partition_column is None:
        return {"url": url, "query": query}
    if bounds is None or partitions is None:
        raise ValueError("a partitioned read needs bounds and a number of partitions")
    return {
        "url": url,
        # Spark takes a partition column only together with dbtable.
        "dbtable": f"({query}) q",
        "partitionColumn": partition_column,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }


def read_query(spark: SparkSession, url_variable: str, query: str, **partitioning) -> DataFrame:
    """Result of a SQL query in an external database."""
    options = query_options(url_variable, query, **partitioning)
    return spark.read.format("jdbc").options(**options).load()


def write_table(df: DataFrame, target: str, partition_by: str | None = None) -> None:
    """Replace a parquet folder, or a catalog table when ``target`` has no slash."""
    if partition_by:
        # Gathers each period into few files; AQE splits the large ones.
        df = df.hint("rebalance", F.col(partition_by))
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if "/" in target:
        writer.save(target)
    else:
        writer.saveAsTable(target)


def replace_periods(df: DataFrame, target: str, partition_by: str) -> None:
    """Replace only the periods that ``df`` holds, in a table that ``write_table`` has written by period.

    All other periods stay as they are. An empty ``df`` replaces nothing.
    """
    df = df.hint("rebalance", F.col(partition_by))
    if "/" in target:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(target)
        return
    # A catalog table takes columns by position, and the mode from the session.
    conf, mode = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(mode)
    conf.set(mode, "dynamic")
    try:
        df.select(*df.sparkSession.table(target).columns).write.insertInto(target, overwrite=True)
    finally:
        conf.set(mode, before)


def write_sheet(df: DataFrame, path: str) -> None:
    """Chart-ready result as CSV with a header."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NULL").csv(path)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def use_database(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentDatabase(name)
