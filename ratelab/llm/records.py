"""Token ids as length-delimited binary records, with an offset index beside them.

A record is: length of its payload (8 bytes), masked checksum of those bytes
(4), payload, masked checksum of the payload (4), and a line feed, all
little-endian. The payload is: flags (1; bit 0: no document id), bytes per id
(1; 2 or 4), document id (8, signed), ids. Files are in ascending order of
document ids, from part to part and inside each part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ratelab.llm.common import fresh, parts
from ratelab.llm.encoding import encoder

END = 0  # id after each document
FILE_TEXT = 16 << 20  # bytes of text to a file; a longer document has a file of its own size
_HEAD = struct.Struct("<QI")
_INFO = struct.Struct("<BBq")
_SUM = struct.Struct("<I")


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted, so that a checksum of data that hold checksums stays a good one."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = 4 if len(ids) and ids.max() > 0xFFFF else 2
    payload = _INFO.pack(doc_id is None, wide, doc_id or 0) + ids.astype(f"<u{wide}").tobytes()
    length = len(payload).to_bytes(8, "little")
    return b"".join([length, _SUM.pack(masked(length)), payload, _SUM.pack(masked(payload))])


def records(content: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, document id, ids) of each record of a file; ValueError if a checksum is wrong."""
    at, view = 0, memoryview(content)
    while at < len(content):
        length, crc = _HEAD.unpack_from(content, at)
        if masked(content[at : at + 8]) != crc:
            raise ValueError(f"damaged record length at {at}")
        start, stop = at + _HEAD.size, at + _HEAD.size + length
        payload = view[start:stop]
        if len(payload) < length or masked(payload) != _SUM.unpack_from(content, stop)[0] or content[stop + 4 : stop + 5] != b"\n":
            raise ValueError(f"damaged record at {at}")
        none, wide, doc_id = _INFO.unpack_from(payload)
        ids = np.frombuffer(payload, f"<u{wide}", offset=_INFO.size)
        yield at, stop + 5 - at, None if none else doc_id, ids
        at = stop + 5


def write_records(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end: int = END, file_text: int = FILE_TEXT) -> None:
    """Encode every row and write its record; rows are in order of ids, null ids first, repeated ones by row.

    Spark's own writer writes the files, so a lost or repeated task leaves
    neither parts nor doubles, in any store that Spark can reach. Files hold
    ``file_text`` bytes of text on average; ranges balance rows, so files of
    long documents are larger than others.
    """
    row = fresh(docs, "row")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The row number splits an id that very many rows share.
    rows = rows.withColumn(row, F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(parts(size, file_text), "doc_id", row).sortWithinPartitions("doc_id", row)

    @F.pandas_udf("binary")
    def framed(ids: pd.Series, missing: pd.Series, texts: pd.Series) -> pd.Series:
        own, last = encoder(vocabulary), end.to_bytes(4, "little")
        return pd.Series([
            frame(None if none else int(i), np.frombuffer(x + last, "<u4")) for i, none, x in zip(ids, missing, own.encode_all(texts))
        ])

    made = framed(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("text"))
    ordered.select(made.cast("string").alias("record")).write.option("lineSep", "\n").text(f"{path}/records")


def index_records(spark: SparkSession, path: str) -> DataFrame:
    """Read the files back, check every checksum, and write and return the index.

    ``file, part, record, offset, length, doc_id, n_tokens, ids_crc32``; the
    last one is the CRC-32 of the ids as little-endian 32-bit integers.
    """
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                out = [(i, at, n, doc, len(ids), zlib.crc32(ids.astype("<u4"))) for i, (at, n, doc, ids) in enumerate(records(bytes(content)))]
                made = pd.DataFrame(out, columns=["record", "offset", "length", "doc_id", "n_tokens", "ids_crc32"])
                made["doc_id"] = made["doc_id"].astype("Int64")
                yield made.assign(file=file)[["file", "record", "offset", "length", "doc_id", "n_tokens", "ids_crc32"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    found = names.mapInPandas(scan, "file string, record long, offset long, length long, doc_id long, n_tokens long, ids_crc32 long")
    found = found.withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
    found.write.parquet(f"{path}/index")
    return spark.read.schema(found.schema).parquet(f"{path}/index")


def positions(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids in all records before, in file order.

    Files' totals are added up first, so no task sees more than one file's
    records or one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    files = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("record").rowsBetween(Window.unboundedPreceding, -1))
    own = index.withColumn("own", F.coalesce(inside, F.lit(0)))
    return own.join(files, "part").withColumn("start", F.col("own") + F.col("file_start")).drop("own", "file_start")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """``doc_id, ids`` of all records in an order that depends on ``seed`` alone, by way of the index.

    Records are cut out of the files at the index's offsets, on the executors.
    """
    order = F.xxhash64(F.lit(seed), "file", "record")
    index = spark.read.parquet(f"{path}/index").withColumn("order", order)
    # One row per file, with the places of its records: bounded by the file.
    places = index.groupBy("file").agg(F.collect_list(F.struct("offset", "length", "order")).alias("places"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(places, "file")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, at in zip(batch["content"], batch["places"]):
                found = [next(records(content[x["offset"] : x["offset"] + x["length"]])) for x in at]
                made = pd.DataFrame({"doc_id": [x[2] for x in found], "ids": [x[3].astype(np.int64) for x in found], "order": [x["order"] for x in at]})
                yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    return files.mapInPandas(cut, "doc_id long, ids array<long>, order long").orderBy("order", "doc_id").select("doc_id", "ids")


def token_records(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per row of ``docs``, from the written files.

    Null text is empty and holds the end id alone. An empty table gives an
    empty result. Only ids and texts are read.
    """
    write_records(docs, path, vocabulary, doc_id, text)
    return positions(index_records(docs.sparkSession, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
