"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of fixed size. Equal blocks get equal integer
names and different blocks different ones, by sorting their contents. Adjacent
pairs of names are then named in the same way, level by level, until each text
has one name. No hash decides equality: hashes only choose where rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratelab.llm.common import HOT_SHARE, attach, fresh, numbered, text_or_empty
from ratelab.scratch import Scratch

BLOCK = 4096  # code points
_BUCKETS = 1 << 31


def normalised(name: str) -> Column:
    """Each run of ASCII white space as one space (single spaces need no work)."""
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(text_or_empty(name), runs, " ")


def name_contents(df: DataFrame, content: list[str], row: list[str], carried: list[str], scratch: Scratch, level: int) -> DataFrame:
    """``df``'s ``row`` and ``carried`` columns with ``name``, an integer per distinct ``content``.

    Contents are sorted inside narrow hash buckets; a name is the bucket and
    the content's place in it, so two contents never share one. A content with
    over 1 / HOT_SHARE of all rows (fewer than HOT_SHARE such contents exist)
    is named from a broadcast list of them, and its rows are spread evenly.
    The result is stored.
    """
    # Contents are made and hashed once; the counts read the hashes alone.
    contents = f"contents{level}"
    df = scratch.keep(df.withColumn("hash", F.xxhash64(*content)), contents)
    counts = scratch.keep(df.groupBy("hash").count(), f"counts{level}")
    total = counts.agg(F.sum("count")).first()[0] or 0
    limit = max(total // HOT_SHARE, 1)
    heavy = [r["hash"] for r in counts.filter(F.col("count") > limit).select("hash").collect()]
    bucket = F.pmod("hash", F.lit(_BUCKETS))
    hot_name = F.lit(None).cast("long")
    if heavy:
        # The hash narrows the search; the count on contents proves the bound.
        found = (
            df.filter(F.col("hash").isin(heavy))
            .groupBy(*content).count().filter(F.col("count") > limit)
            .select(*content, (-F.row_number().over(Window.orderBy(*content))).cast("long").alias("hot"))
        )
        df = df.join(F.broadcast(found), content, "left")
        hot_name = F.col("hot")
        bucket = F.when(hot_name.isNull(), bucket).otherwise(F.pmod(F.xxhash64(*row), F.lit(_BUCKETS)))
    content_or_null = [F.when(hot_name.isNull(), F.col(c)).alias(c) for c in content]
    place = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*content))
    named = df.select(
        *row, *carried, *content_or_null, hot_name.alias("hot_name"), bucket.cast("long").alias("bucket")
    ).select(
        *row, *carried,
        F.coalesce("hot_name", F.shiftleft("bucket", 32) + place.cast("long")).alias("name"),
    )
    named = scratch.keep(named, f"names{level}")
    scratch.drop(contents)
    return named


def name_texts(
    docs: DataFrame, row: str, text: str, scratch: Scratch, block: int = BLOCK, extra: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``row``, ``blocks``, ``length``, ``name``, ``extra`` columns.

    Texts are equal exactly when ``blocks``, ``length`` and ``name`` are.
    Null text counts as empty. Memory is bounded by one text and by sorting
    that can spill. The result is stored.
    """
    extra = extra or {}
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    texts = docs.select(F.col(row).alias("row"), normalised(text).alias("norm"), *[c.alias(k) for k, c in extra.items()])
    info = texts.select(
        "row", *extra, F.length("norm").cast("long").alias("length"),
        F.sha2("norm", 256).alias("sha256"),
        F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut).alias("cut"),
    ).withColumn("blocks", F.size("cut"))
    fixed = ["blocks", "length", "sha256", *extra]
    pieces = info.select("row", *fixed, F.posexplode("cut").alias("pos", "block"))
    # What describes the text travels with its first block only.
    pieces = pieces.select(
        "row", "pos", "block", "blocks",
        *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in fixed if c != "blocks"],
    )
    carried = [c for c in pieces.columns if c not in ("row", "pos", "block")]
    level = name_contents(pieces, ["block"], ["row", "pos"], carried, scratch, 0)
    first = level.filter("pos = 0")
    done = first.filter("blocks = 1").select("row", "name")
    names = level.filter("blocks > 1").select("row", "pos", F.col("blocks").alias("width"), "name")
    widest = level.agg(F.max("blocks")).first()[0] or 1
    step = 0
    while widest > 1:
        step += 1
        half = F.floor(F.col("pos") / 2).cast("int")
        pairs = names.groupBy("row", half.alias("pos"), F.ceil(F.col("width") / 2).cast("int").alias("width")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            # No content is ever named 0: it stands for a missing right half.
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("right"),
        )
        level = name_contents(pairs, ["left", "right"], ["row", "pos"], ["width"], scratch, step)
        done = done.unionByName(level.filter("width = 1").select("row", "name"))
        names = level.filter("width > 1")
        widest = -(-widest // 2)
    return scratch.keep(first.select("row", *fixed).join(done, "row"), "named")


def exact_duplicates(
    docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", row: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``row, doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when identical after each run of ASCII white space became
    one space; null text is empty. Of equal texts the row with the smallest
    doc_id stays, exactly one even if ids repeat (then the first stored row);
    null ids come last. An empty table gives an empty result. Other columns
    are not read, whatever their names.
    """
    if row is None:
        row = fresh(docs, "row")
        docs = docs.select(doc_id, text).withColumn(row, F.monotonically_increasing_id())
    key = ["blocks", "length", "name"]
    named = name_texts(docs, row, text, scratch, block, {"doc_id": F.col(doc_id)})
    groups = named.groupBy(*key).agg(
        F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    )
    groups = scratch.keep(groups.select(*key, F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "groups")
    return attach(named, groups, key, "group_size", named.count()).select(
        "row", "doc_id", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha256").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stored, row = numbered(docs, scratch)
    stay = exact_duplicates(stored, scratch, doc_id, text, row).filter("kept").select(F.col("row").alias(row))
    return stored.join(stay, row, "left_semi").drop(row)
