"""SimHash near duplicates by bit-sliced comparison.

Fingerprints that differ in few bits agree on whole groups of bits, so all
candidates meet in buckets of such groups; nothing is missed. Inside a bucket,
fingerprints are stored as bit planes (plane k holds bit k of 64 fingerprints
in one word) and one word operation updates 64 distances at once: counters are
words too, added with carries, and a block of 64 is abandoned once all its
distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ratelab.llm.common import attach, fresh, numbered, parts, words_in_chunks
from ratelab.llm.components import components
from ratelab.scratch import Scratch

SEED = 42
WORDS = 3
RADIUS = 3
SIDE = 2048  # fingerprints of a bucket compared with as many others at once
BIN_ROWS = 40_000
_CHUNK = 1 << 17  # bytes of a text cut into words at once
_PAIRS = 1 << 15  # (fingerprint, block of 64) pairs compared at once


def _shingle_hashes(data: bytes, words: int) -> Iterator[list[int]]:
    """Hashes of all shingles, some at a time."""
    digest, total, found = xxhash.xxh64_intdigest, 0, []
    for found in words_in_chunks(data, words - 1, _CHUNK):
        n = len(found) - words + 1
        if n > 0:
            # Shingles are slices of the space-joined text between word starts.
            joined = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            starts = [0, *(ends[: n - 1] + 1).tolist()]
            yield [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
            total += n
    if not total and found:
        yield [digest(b" ".join(found), SEED)]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit number; 0 without words."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in _shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower(), words):  # A-Z only
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, row: str, doc_id: str, text: str, words: int = WORDS) -> DataFrame:
    """``row, doc_id, print`` (signed long) per row of ``docs``."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, words) for x in texts], dtype="int64")

    return docs.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), prints(F.col(text).cast("string")).alias("print"))


def bit_groups(n: int, radius: int) -> list[int]:
    """Masks of which at least one covers only equal bits of any two prints within ``radius``.

    The 64 bits are cut into radius + j runs; some j of them agree. More runs
    give longer keys and more tables; j follows the number of prints so that
    a key is shared by few unrelated ones.
    """
    j = 1
    while j < 4 and n > 64 * 2 ** (64 * j // (radius + j)):
        j += 1
    cuts = [64 * i // (radius + j) for i in range(radius + j + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(runs, j)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of all pairs; every class is named by its smallest member."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def close_classes(prints: np.ndarray, unit: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each print the index of the smallest one linked to it inside its unit.

    ``unit`` is sorted. Bit-sliced: blocks of up to 64 prints of a unit as 64
    planes, every print of the unit against every block not before its own.
    """
    n = len(prints)
    parent = np.arange(n)
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if n else np.array([], int)
    sizes = np.diff(np.r_[starts, n])
    rank = np.arange(n) - np.repeat(starts, sizes)
    per_unit = -(-sizes // 64)
    first_block = np.cumsum(per_unit) - per_unit
    block = np.repeat(first_block, sizes) + rank // 64
    lane = (rank % 64).astype(np.uint64)
    blocks = int(per_unit.sum())
    block_start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if n else starts
    filled = np.add.reduceat(np.uint64(1) << lane, block_start) if n else np.array([], np.uint64)
    planes = np.empty((64, blocks), np.uint64)
    for k in range(64):
        planes[k] = np.add.reduceat(((prints >> np.uint64(k)) & np.uint64(1)) << lane, block_start) if n else 0
    last_block = np.repeat(first_block + per_unit, sizes)  # behind the unit's last
    todo = np.where(np.repeat(sizes, sizes) > 1, last_block - block, 0)
    ends = np.cumsum(todo)
    width = max(1, radius.bit_length())
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        count = todo[at:stop]
        one = np.repeat(np.arange(at, stop), count)
        other = np.repeat(block[at:stop], count) + np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count)
        at = stop
        # Lanes that don't count: unfilled ones, and in the own block those up to itself.
        over = ~filled[other]
        own = block[one] == other
        over[own] |= (np.uint64(2) << lane[one[own]]) - np.uint64(1)
        sums = np.zeros((width, len(one)), np.uint64)
        for k in range(64):
            carry = planes[k, other] ^ (np.uint64(0) - ((prints[one] >> np.uint64(k)) & np.uint64(1)))
            for s in sums:
                s[:], carry = s ^ carry, s & carry
            over |= carry
            if k % 8 == 7:
                alive = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not alive.all():
                    one, other, over, sums = one[alive], other[alive], over[alive], sums[:, alive]
                if not len(one):
                    break
        if not len(one):
            continue
        # Distances that fit the counters but not the radius.
        above, equal = np.zeros_like(over), ~np.zeros_like(over)
        for b in reversed(range(width)):
            if radius >> b & 1:
                equal &= sums[b]
            else:
                above |= equal & sums[b]
                equal &= ~sums[b]
        hits = ~(over | above)
        some = hits != 0
        one, other, hits = one[some], other[some], hits[some]
        bits = np.unpackbits(hits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, at_lane = np.nonzero(bits)
        _merge(parent, one[which], block_start[other[which]] + at_lane)
    return parent


def close_links(prints: DataFrame, n: int, radius: int, scratch: Scratch) -> DataFrame:
    """Links (``a``, ``b``) that connect all distinct ``print`` values within ``radius`` bits.

    ``prints`` holds each value once. Links span what is linked: no pair within
    the radius stays unconnected, but not every pair is a row. A bucket larger
    than SIDE is compared in blocks: each of its parts meets each other one.
    """
    masks = bit_groups(n, radius)
    keyed = prints.select(
        "print", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("print").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")
    ).select("print", "k.t", "k.key")
    sizes = scratch.keep(keyed.groupBy("t", "key").count().filter("count > 1"), "buckets")
    split = F.ceil(F.col("count") / SIDE)
    total = sizes.agg(F.sum(F.col("count") * split)).first()[0]
    if not total:
        return prints.select(F.col("print").alias("a"), F.col("print").alias("b")).limit(0)
    met = attach(keyed, sizes, ["t", "key"], "count", n * len(masks)).select("print", "t", "key", split.cast("int").alias("split"))
    met = met.withColumn("part", F.pmod(F.xxhash64("print"), "split").cast("int"))
    met = met.select("print", "t", "key", "part", F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("with"))
    met = met.select("print", "t", "key", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"))
    bins = parts(int(total), BIN_ROWS)
    met = met.select("print", "t", "key", "p", "q", F.pmod(F.xxhash64("t", "key", "p", "q"), F.lit(bins)).alias("bin"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t", "key", "p", "q", "print"], kind="stable")
        unit = group.groupby(["t", "key", "p", "q"], sort=True).ngroup().to_numpy()
        own = group["print"].to_numpy()
        parent = close_classes(own.view(np.uint64), unit, radius)
        linked = parent != np.arange(len(own))
        return pd.DataFrame({"a": own[parent[linked]], "b": own[linked]})

    return met.groupBy("bin").applyInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", row: str | None = None,
    words: int = WORDS, radius: int = RADIUS,
) -> DataFrame:
    """``row, doc_id, fingerprint, component_id, component_row`` for every row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked, and
    linked rows form components; component_id is the smallest doc_id of one
    (null ids come last), component_row the row that has it (the first of
    repeated ones). Null and blank texts have fingerprint zero and link like
    any other. An empty table gives an empty result. Other columns are not read.
    """
    if row is None:
        row = fresh(docs, "row")
        docs = docs.select(doc_id, text).withColumn(row, F.monotonically_increasing_id())
    prints = scratch.keep(fingerprints(docs, row, doc_id, text, words), "prints")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    distinct = scratch.keep(prints.groupBy("print").agg(first.alias("first"), F.count(F.lit(1)).alias("size")), "distinct")
    total, n = distinct.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    links = close_links(distinct.select("print"), n, radius, scratch)
    roots = scratch.keep(components(links, scratch), "roots")
    # A print without links is its own component.
    of = distinct.join(roots, F.col("node") == F.col("print"), "left").withColumn("root", F.coalesce("root", "print"))
    of = scratch.keep(of.select("print", "root", "first", "size"), "of")
    heads = of.groupBy("root").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("prints"))
    of = attach(of.select("print", "root", "size"), heads, ["root"], "prints", n)
    of = scratch.keep(of.select("print", "size", "head"), "heads")
    return attach(prints, of, ["print"], "size", total).select(
        "row", "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("head.id").alias("component_id"), F.col("head.row").alias("component_row"),
    )


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay (one of each component), with all their columns."""
    stored, row = numbered(docs, scratch, "near_input")
    stay = near_duplicates(stored, scratch, doc_id, text, row).filter("row = component_row").select(F.col("row").alias(row))
    return stored.join(stay, row, "left_semi").drop(row)
