"""Helpers the operators share: tables, row numbers, joins that survive hot keys."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ratelab.scratch import Scratch

# A group with more than 1/HOT_SHARE of all rows is hot. Group sizes add up to
# the number of rows, so there are fewer than HOT_SHARE hot groups, always.
HOT_SHARE = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, scratch: Scratch, name: str = "input") -> tuple[DataFrame, str]:
    """``df`` stored with a row number column, and that column's name.

    Numbers from ``monotonically_increasing_id`` may differ when a scan is run
    again, so the rows are stored with them once.
    """
    row = fresh(df, "row")
    return scratch.keep(df.withColumn(row, F.monotonically_increasing_id()), name), row


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def parts(rows: int, per_part: int) -> int:
    return max(1, -(-rows // per_part))


def attach(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per group on non-null ``key``.

    ``size`` is a column of ``groups``: the number of rows of that key, which
    add up to ``total`` at most. Hot groups are broadcast (under HOT_SHARE of
    them by construction), so their rows stay where they are; the others are
    shuffled, and none of them holds more than total / HOT_SHARE rows.
    """
    limit = max(total // HOT_SHARE, 1)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    cold = groups.filter(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(
        rows.join(hot.select(*key), key, "left_anti").join(cold, key)
    )


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_in_chunks(data: bytes, carry: int, chunk: int = 1 << 19) -> Iterator[list[bytes]]:
    """Words between ASCII white space, some at a time; each list starts with the last ``carry`` of the one before.

    A very long text is never held as a list of words.
    """
    tail: list[bytes] = []
    at = 0
    while at < len(data):
        gap = _SPACE.search(data, at + chunk)
        end = gap.start() if gap else len(data)
        found = tail + data[at:end].split()
        at = end
        yield found
        tail = found[max(0, len(found) - carry) :]
