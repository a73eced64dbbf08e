"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Pieces of equal length are interchangeable, so the instance is a histogram of
at most ``capacity`` lengths, whatever the number of documents. The packing is
found on the histogram, as patterns with multiplicities; documents get their
places by their rank among pieces of the same length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ratelab.llm.common import fresh
from ratelab.llm.encoding import encoder
from ratelab.scratch import Scratch

CAPACITY = 4096
END = 1  # id after each document

# A pattern is a list of (length, copies); a plan is a list of (pattern, bins).
Plan = list[tuple[list[tuple[int, int]], int]]


class _Counts:
    """A multiset of lengths, with its lengths sorted."""

    def __init__(self, counts: dict[int, int]):
        self.of = {w: n for w, n in counts.items() if n > 0}
        self.lengths = sorted(self.of)

    def take(self, w: int, n: int) -> None:
        self.of[w] -= n
        if not self.of[w]:
            del self.of[w]
            del self.lengths[bisect_left(self.lengths, w)]

    def largest(self, at_most: int) -> int:
        i = bisect_left(self.lengths, at_most + 1)
        return self.lengths[i - 1] if i else 0

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for w in self.lengths:
            out += [w] * min(self.of[w], n - len(out))
            if len(out) == n:
                break
        return out


def _best_pair(items: _Counts, room: int) -> tuple[int, int]:
    """The two items with the largest sum of at most ``room``, larger one first; (0, 0) without any."""
    best, pair = 0, (0, 0)
    lengths = items.lengths
    hi = len(lengths) - 1
    for lo, b in enumerate(lengths):
        while hi >= lo and lengths[hi] + b > room:
            hi -= 1
        if hi < lo:
            break
        a = lengths[hi]
        if a == b and items.of[a] < 2:
            a = lengths[hi - 1] if hi - 1 >= lo else 0
        if a and a + b > best and (a != b or items.of[a] > 1):
            best, pair = a + b, (a, b)
    return pair


def _dominant(items: _Counts, w: int, room: int) -> list[int] | None:
    """Partners of ``w`` (already taken out) such that no other set with it can be better; None if unproven."""
    large = items.largest(room)
    if not large:
        return []
    if large == room:
        return [large]
    small = items.smallest(3)
    if len(small) < 2 or small[0] + small[1] > room:
        return [large]  # one more item fits, and this is the largest
    if len(small) == 3 and sum(small) <= room:
        return None
    a, b = _best_pair(items, room)
    if large >= a + b:
        return [large]
    if a == large:
        # The two items next above b, in falling order, do not fit together.
        above, i = [], bisect_left(items.lengths, b)
        spare = items.of[b] - 1 - (a == b)
        above += [b] * min(2, max(0, spare))
        for v in items.lengths[i + 1 :]:
            if len(above) >= 2:
                break
            above += [v] * min(2 - len(above), items.of[v])
        if len(above) < 2 or sum(above) > room:
            return [a, b]
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Bins that some optimal packing holds, and the lengths that remain."""
    items, fixed = _Counts(counts), []
    changed = True
    while changed and items.lengths:
        changed = False
        w = items.lengths[-1]
        while w:
            n = items.of[w]
            items.take(w, 1)
            with_it = _dominant(items, w, capacity - w)
            if with_it is None:
                if w in items.of:
                    items.of[w] += 1
                else:
                    insort(items.lengths, w)
                    items.of[w] = 1
            else:
                changed = True
                pattern: dict[int, int] = {w: 1}
                for v in with_it:
                    pattern[v] = pattern.get(v, 0) + 1
                # Items only become fewer, so a single or a pair stays dominant while its lengths last.
                bins = 1
                if len(with_it) < 2:
                    have = {v: (n if v == w else items.of[v]) for v in pattern}
                    bins = min(have[v] // k for v, k in pattern.items())
                for v, k in pattern.items():
                    gone = bins * k - (v == w)
                    if gone:
                        items.take(v, gone)
                fixed.append((list(pattern.items()), bins))
                if w in items.of:
                    continue
            w = items.largest(w - 1)
    return fixed, dict(items.of)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit, largest lengths first, on equal bins at once."""
    open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def add(pattern: list[tuple[int, int]], bins: int, room: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((pattern, bins))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                room, pattern, bins = capacity, [], n
            else:
                room = rooms[i]
                pattern, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[i]
            # The tightest bin stays the tightest until it is full.
            copies = min(room // w, n)
            used = min(bins, n // copies)
            if pattern and used < bins:
                add(pattern, bins - used, room)
            add([*pattern, (w, copies)], used, room - copies * w)
            n -= used * copies
    return [x for xs in open_bins.values() for x in xs]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(plan: Plan) -> pd.DataFrame:
    """Where pieces go: ranks from ``first`` on of a length, ``copies`` to a sequence from ``sequence`` on, at ``offset``."""
    rows, used, sequence = [], {}, 0
    for pattern, bins in plan:
        offset = 0
        for w, copies in pattern:
            rows.append((w, used.get(w, 0), copies, sequence, offset))
            used[w] = used.get(w, 0) + copies * bins
            offset += w * copies
        sequence += bins
    return pd.DataFrame(rows, columns=["length", "first", "copies", "sequence", "offset"], dtype=np.int64).sort_values(["length", "first"])


def token_pieces(docs: DataFrame, row: str, doc_id: str, text: str, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """``row, doc_id, piece, start, length, ids_crc32`` of every document's pieces, its end id included."""

    @F.pandas_udf("struct<n: long, crcs: array<long>>")
    def encoded(texts: pd.Series) -> pd.DataFrame:
        own, step, end = encoder(vocabulary), 4 * capacity, END.to_bytes(4, "little")
        lengths, sums = [], []
        for ids in own.encode_all(texts):
            ids += end
            lengths.append(len(ids) // 4)
            sums.append([zlib.crc32(ids[i : i + step]) for i in range(0, len(ids), step)])
        return pd.DataFrame({"n": lengths, "crcs": sums})

    tokens = docs.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), encoded(F.col(text).cast("string")).alias("t"))
    start = F.col("piece") * F.lit(capacity).cast("long")
    return tokens.select("row", "doc_id", "t.n", F.posexplode("t.crcs").alias("piece", "ids_crc32")).select(
        "row", "doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).cast("long").alias("length"), "ids_crc32"
    )


def ranked(pieces: DataFrame) -> DataFrame:
    """Stored ``pieces`` with ``rank``, their place among those of equal length.

    A length may hold a third of all pieces: rows are ranked inside the part of
    the table they were read in, and the parts' counts are added up.
    """
    blocks = pieces.withColumn("block", F.shiftright("row", 33))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("block", "length").orderBy("row", "piece")) - 1
    return blocks.withColumn("own", own).join(counts, ["block", "length"]).withColumn("rank", F.col("own") + F.col("before")).drop("block", "own", "before")


def placed(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Stored ``pieces`` with ``sequence_id`` and ``offset``; offsets in a sequence have no gaps."""
    # At most one row per length comes to the driver: capacity rows.
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    where = slots(plan_bins(histogram, capacity))
    # Patterns follow from the lengths, not from the number of documents.
    at = {c: where[c].to_numpy() for c in where}
    order = (at["length"] << 48) + at["first"]

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        i = np.searchsorted(order, (length.to_numpy(np.int64) << 48) + rank.to_numpy(np.int64), "right") - 1
        bins, inside = np.divmod(rank.to_numpy(np.int64) - at["first"][i], at["copies"][i])
        return pd.DataFrame({"sequence_id": at["sequence"][i] + bins, "offset": at["offset"][i] + inside * at["length"][i]})

    return ranked(pieces).withColumn("at", find("length", "rank")).withColumns(
        {"sequence_id": F.col("at.sequence_id"), "offset": F.col("at.offset")}
    ).drop("at", "rank")


def pack(docs: DataFrame, scratch: Scratch, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row.

    Null text is empty: its one piece holds the end id alone. Only documents
    longer than ``capacity`` are cut. Repeated rows are packed each; ties are
    broken by row. An empty table gives an empty result. Only ids and texts
    are read.
    """
    row = fresh(docs, "row")
    rows = docs.select(doc_id, text).withColumn(row, F.monotonically_increasing_id())
    pieces = scratch.keep(token_pieces(rows, row, doc_id, text, vocabulary, capacity), "pieces")
    return placed(pieces, scratch, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, layout: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The packed ids themselves: ``sequence_id, ids``, for a ``layout`` of ``pack`` over unique non-null ids."""

    @F.pandas_udf("array<array<int>>")
    def cut(texts: pd.Series) -> pd.Series:
        own = encoder(vocabulary)
        every = [np.frombuffer(x + END.to_bytes(4, "little"), "<u4").astype(np.int32) for x in own.encode_all(texts)]
        return pd.Series([[x[i : i + capacity] for i in range(0, len(x), capacity)] for x in every])

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(cut(F.col(text).cast("string"))).alias("piece", "ids"))
    # A sequence holds at most ``capacity`` ids, so its group is bounded.
    return ids.join(layout, ["doc_id", "piece"]).groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
