"""Lookup tables: uniqueness, assignment with a sentinel, compact codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def unique_lookup(lookup: DataFrame, key: str, value: str) -> DataFrame:
    """The lookup with one row per key; a repeated key is an error when read."""
    return lookup.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.when(
            F.count(F.lit(1)) > 1,
            F.raise_error(F.concat(F.lit(f"{key} is repeated in the lookup: "), F.col(key).cast("string"))),
        )
        .otherwise(F.max(value))
        .alias(value)
    )


def assign_lookup(
    df: DataFrame, lookup: DataFrame, key: str, value: str, alias: str, unmatched: int
) -> DataFrame:
    """Set ``alias`` from the lookup.

    Rows without a lookup row get ``unmatched``; rows whose lookup value is
    null get null, which a plain ``coalesce`` would not keep apart.
    """
    found = unique_lookup(lookup, key, value).select(
        F.col(key), F.col(value).alias("_value"), F.lit(True).alias("_found")
    )
    return (
        df.join(found, key, "left")
        .withColumn(alias, F.when(F.col("_found"), F.col("_value")).otherwise(F.lit(unmatched)))
        .drop("_value", "_found")
    )


def compact_codes(
    dimension: DataFrame, key: str, attributes: list[str], code: str
) -> tuple[DataFrame, DataFrame]:
    """Replace a set of attribute columns by one 64-bit code.

    Returns (key, code) rows to join facts with and (code, attributes) rows to
    decode results with. Keys with equal attributes share a code, so counting
    distinct people per code equals counting them per attribute set. Repeated
    keys stay repeated, as a join with the dimension itself would repeat them.
    Two attribute sets with the same code are an error when read.
    """
    parts = [c for a in attributes for c in (F.col(a).isNull(), F.col(a))]
    coded = dimension.withColumn(code, F.xxhash64(*parts))
    return coded.select(key, code), _decode(coded, attributes, code)


def _decode(coded: DataFrame, attributes: list[str], code: str) -> DataFrame:
    ends = coded.groupBy(code).agg(
        F.min(F.struct(*attributes)).alias("low"), F.max(F.struct(*attributes)).alias("high")
    )
    checked = F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise(
        F.raise_error(F.lit(f"two attribute sets share a {code} code"))
    )
    return ends.select(code, checked.alias("attributes")).select(code, "attributes.*")
