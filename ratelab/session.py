"""Session settings the library's plans rely on for speed (never for results)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

# A lookup of at most this many bytes is sent to every executor.
BROADCAST_BYTES = 50 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Let joins on (patient, period) reuse an existing partitioning by patient.

    The one option the plans rely on; all others are the caller's.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def _bytes(table: DataFrame) -> Column:
    """Bytes of all rows: texts by their length, numbers and dates as eight."""
    width = 8 * sum(not isinstance(f.dataType, StringType) for f in table.schema)
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) + 8 for f in table.schema if isinstance(f.dataType, StringType)]
    return F.coalesce(F.sum(reduce(add, texts, F.lit(width))), F.lit(0))


def broadcast_checked(*tables: DataFrame, limit: int = BROADCAST_BYTES) -> list[DataFrame]:
    """Mark each table for broadcast if it is measured to hold at most ``limit`` bytes.

    All tables are measured in one job. Larger tables are returned unmarked,
    so Spark joins them by shuffle.
    """
    sizes = None
    for i, table in enumerate(tables):
        one = table.agg(_bytes(table).alias("n")).select(F.lit(i).alias("i"), "n")
        sizes = one if sizes is None else sizes.unionAll(one)
    found = {r["i"]: r["n"] for r in sizes.collect()}
    return [F.broadcast(t) if found[i] <= limit else t for i, t in enumerate(tables)]
