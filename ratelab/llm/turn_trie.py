"""Prefix trie of conversations by union-find over edges between sorted neighbours.

A conversation is its sequence of turn digests. Distinct sequences are sorted,
so that all that share a prefix stand together, and neighbours are joined by
edges that carry the length of their common prefix (LCP). Taking edges in
descending LCP, each union of two components makes the branching node where
they part. Sorted ranges do this on their own. A node whose prefix also lies in
a neighbouring range stays open there; such nodes, two paths a range at most,
are all that is left of a range, and equal ones of different ranges are merged
by adding them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ratelab.scratch import Scratch

_WIDTH = 16  # bytes of a turn's digest
_OUT = 50_000  # nodes handed on at once
_NODES = (
    "part int, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends long, "
    "key binary, parent_key binary, parent_conv_id long"
)
_EMPTY = hashlib.sha256(b"").hexdigest()


# --- conversations as sequences of turn digests ------------------------------------


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, seq``: the digests and code points of each conversation's turns, in order.

    Turns stand by number, null first; turns that share a number by the digest
    of role and text, so the order is defined. Null role or text is empty.
    Rows without conv_id belong to no conversation. Texts stay where they are:
    16 bytes a turn move.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The role's length keeps ("ab", "c") apart from ("a", "bc").
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    one = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.substring(F.sha2(whole, 256), 1, 2 * _WIDTH).alias("digest"),
            F.length(text).alias("chars"),
        ).alias("t"),
    )
    return one.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("t")), lambda t: t.dropFields("turn")).alias("seq")
    )


def share_openings(seqs: DataFrame, every: int = 100, longest: int = 5) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % ``every``.

    h is the CRC-32 of the decimal c, modulo ``longest`` + 1. All opening turns
    are taken if that conversation has fewer, and none if it is absent.
    A key of the join has at most 2 * ``every`` - 1 rows.
    """
    base = seqs.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("seq", 1, longest).alias("opening")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)).cast("int")
    own = F.filter("seq", lambda _, i: i >= F.col("h"))
    opening = F.filter("opening", lambda _, i: i < F.col("h"))
    return (
        seqs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
        .join(base, "base", "left")
        .select("conv_id", F.when(F.col("opening").isNull(), own).otherwise(F.concat(opening, own)).alias("seq"))
    )


# --- one sorted range ----------------------------------------------------------------


def common_turns(a: bytes, b: bytes) -> int:
    """Length of the common prefix, in turns."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // _WIDTH
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // _WIDTH


@dataclass
class _Tree:
    """A component: sequences first to last, whose topmost node so far is at ``depth``."""

    first: int
    last: int
    depth: int
    conv: int
    convs: int
    children: int = 0
    leaves: int = 0
    saved: int = 0  # below the top node
    ends: int | None = None
    waiting: list[list] = field(default_factory=list)  # children whose parent is the top node


class Forest:
    """Nodes of one sorted range of distinct sequences.

    ``left`` and ``right`` are the LCP with the sequences next to the range, -1
    where there is none. Nodes at those depths or above, on the first or last
    path, are open: their numbers hold this range's part only. Parts of
    different ranges add up, for what belongs to the node itself, and its place
    among its parent's children, counts in the first range only.
    """

    def __init__(self, part: int, paths: list[bytes], chars: list, copies: list[int], convs: list[int], left: int, right: int):
        self.part, self.paths, self.chars = part, paths, chars
        self.left, self.right = left, right
        n = len(paths)
        self.lcp = [common_turns(a, b) for a, b in zip(paths, paths[1:])]
        self.trees = []
        for i in range(n):
            depth = len(paths[i]) // _WIDTH
            follower = self.lcp[i] if i < n - 1 else right
            self.trees.append(
                _Tree(i, i, depth, convs[i], copies[i], leaves=int(follower < depth), ends=convs[i])
            )
        self.parent = list(range(n))
        self.out: list[list] = []

    def _find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _open(self, t: _Tree, depth: int) -> tuple[bool, bool]:
        """Whether the node of ``t`` at ``depth`` has parts in the range before, and in that after."""
        return t.first == 0 and depth <= self.left, t.last == len(self.paths) - 1 and depth <= self.right

    def _key(self, i: int, depth: int) -> bytes:
        return hashlib.sha256(self.paths[i][: depth * _WIDTH]).digest()

    def _rise(self, t: _Tree, depth: int) -> None:
        """Emit the top node of ``t`` and those above it, until its parent is at ``depth``."""
        while t.depth > depth:
            d = t.depth
            before, after = self._open(t, d)
            size = int(self.chars[t.first][d - 1]) if d else 0
            t.saved += (t.convs - (not before)) * size
            key = self._key(t.first, d) if before or after else None
            for child in t.waiting:
                child[-1 if key is None else -2] = t.conv if key is None else key
            self.out += t.waiting
            node = [self.part, d, t.conv, t.convs, t.children, t.leaves, t.saved, t.ends, key, None, None]
            t.depth, t.children, t.ends, t.waiting = d - 1, int(not before), None, [node]

    def _unite(self, a: _Tree, b: _Tree, depth: int) -> _Tree:
        """The node at ``depth`` where ``a`` and ``b`` part."""
        self._rise(a, depth)
        self._rise(b, depth)
        if len(a.waiting) < len(b.waiting):
            a.waiting, b.waiting = b.waiting, a.waiting
        a.waiting += b.waiting
        ends = a.ends if a.ends is not None else b.ends
        return _Tree(
            a.first, b.last, depth, min(a.conv, b.conv), a.convs + b.convs, a.children + b.children,
            a.leaves + b.leaves, a.saved + b.saved, ends, a.waiting,
        )

    def nodes(self) -> Iterator[list[list]]:
        """All nodes of the range, some at a time."""
        for i in np.argsort(-np.array(self.lcp, np.int64), kind="stable").tolist():
            a, b = self._find(i), self._find(i + 1)
            self.trees[a] = self._unite(self.trees[a], self.trees[b], self.lcp[i])
            self.parent[b], self.trees[b] = a, None
            if len(self.out) > _OUT:
                yield self.out
                self.out = []
        top = self.trees[self._find(0)]
        self._rise(top, -1)
        yield self.out + top.waiting


_FRAME = [c.split()[0] for c in _NODES.split(", ")]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, path) to nodes; one part is held at a time."""
    held: list[pd.DataFrame] = []

    def grow() -> Iterator[pd.DataFrame]:
        rows = pd.concat(held)
        one = rows.iloc[0]
        forest = Forest(
            int(one["part"]), rows["path"].tolist(), rows["chars"].tolist(), rows["copies"].tolist(),
            rows["first"].tolist(), int(one["left_lcp"]), int(one["right_lcp"]),
        )
        for some in forest.nodes():
            if some:
                frame = pd.DataFrame(some, columns=_FRAME)
                yield frame.astype({"ends": "Int64", "parent_conv_id": "Int64"})

    for batch in batches:
        for part, rows in batch.groupby("part", sort=False):
            if held and held[0]["part"].iloc[0] != part:
                yield from grow()
                held.clear()
            held.append(rows)
    if held:
        yield from grow()


# --- all ranges ------------------------------------------------------------------------


def turn_trie(seqs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per distinct sequence of first turns, the root included, of ``conv_id, seq`` rows.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (summed
    over the subtree, (n_convs - 1) times the code points of a node's last
    turn) and ``ends`` (smallest conversation that ends at the node, or null).
    conv_id and depth together name a node. conv_id must not repeat in
    ``seqs``. A conversation without turns ends at the root; an empty table has
    no root. Memory of a task: one sorted range of distinct sequences, 20 bytes
    a turn.
    """
    paths = seqs.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("seq", lambda t: t["digest"]), "")).alias("path"),
        F.transform("seq", lambda t: t["chars"]).alias("chars"),
    )
    # Equal sequences have equal code points. Copies leave before anything is sorted.
    distinct = paths.groupBy("path", "chars").agg(F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("first"))
    ranges = scratch.keep(distinct.repartitionByRange("path").withColumn("part", F.spark_partition_id()), "ranges")
    # One row a range: its ends, and what it shares with the ranges beside it.
    ends = scratch.keep(ranges.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high")), "range_ends")
    shared = F.udf(lambda a, b: -1 if a is None or b is None else common_turns(bytes(a), bytes(b)), "int")
    # Ranges are as many as the shuffle has partitions, whatever the input.
    order = Window.orderBy("part")
    beside = ends.select("part", "low", "high", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    beside = beside.select("part", shared("before", "low").alias("left_lcp"), shared("high", "after").alias("right_lcp"))
    rows = ranges.join(F.broadcast(beside), "part")
    nodes = rows.repartition("part").sortWithinPartitions("part", "path").mapInPandas(_forests, _NODES)
    nodes = scratch.keep(nodes, "nodes")

    closed, open_ = nodes.filter("key IS NULL"), nodes.filter("key IS NOT NULL")
    numbers = ["n_convs", "n_children", "n_leaves", "saved"]
    merged = open_.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("ends").alias("ends"),
        F.first("parent_key", ignorenulls=True).alias("parent_key"),
        *[F.sum(c).alias(c) for c in numbers],
    )
    merged = scratch.keep(merged, "merged")
    # A merged node's parent is merged too. At most two of a range share it.
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", *numbers, "ends"]
    top = merged.filter("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    below = merged.filter("parent_key IS NOT NULL").join(parents, "parent_key")
    # Open parents of closed nodes are looked up range by range: a prefix that
    # very many conversations share has its children spread over the ranges.
    named = open_.select("part", F.col("key").alias("parent_key")).join(parents, "parent_key")
    lone = closed.filter("parent_key IS NOT NULL").drop("parent_conv_id").join(named, ["part", "parent_key"])
    done = closed.filter("parent_key IS NULL")
    every = [x.select(*out) for x in (done, lone, below, top)]
    result = every[0].unionAll(every[1]).unionAll(every[2]).unionAll(every[3])
    return result.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "ends",
    )


# --- which conversations end at a node -------------------------------------------------


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (seq_key, conv_id) to comma-joined pieces of each key's list."""
    for batch in batches:
        found = [
            (key, int(ids.iloc[0]), ",".join(map(str, ids.tolist())))
            for key, ids in batch.groupby("seq_key", sort=False)["conv_id"]
        ]
        yield pd.DataFrame(found, columns=["seq_key", "first", "ids"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces sorted by (seq_key, first) to one digest a key, without holding a list whole."""
    key, first, state = None, None, None
    for batch in batches:
        out = []
        for k, f, ids in zip(batch["seq_key"], batch["first"], batch["ids"]):
            if k != key:
                if key is not None:
                    out.append((first, state.hexdigest()))
                key, first, state = k, f, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["ends", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(first, state.hexdigest())], columns=["ends", "ends_sha256"])


def ends_digest(seqs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` with ``ends_sha256``, of the ascending, comma-joined ids of the conversations that end there.

    Ids are sorted over the cluster and joined piece by piece; one task then
    runs a node's pieces through the hash, which cannot be taken in parts.
    """
    key = F.unhex(F.sha2(F.array_join(F.transform("seq", lambda t: t["digest"]), ""), 256))
    own = seqs.select(key.alias("seq_key"), "conv_id").repartitionByRange("seq_key", "conv_id")
    pieces = own.sortWithinPartitions("seq_key", "conv_id").mapInPandas(_listed, "seq_key binary, first long, ids string")
    digests = (
        pieces.repartition("seq_key").sortWithinPartitions("seq_key", "first").mapInPandas(_hashed, "ends long, ends_sha256 string")
    )
    ended = nodes.filter("ends IS NOT NULL").join(scratch.keep(digests, "ends"), "ends")
    other = nodes.filter("ends IS NULL").withColumn("ends_sha256", F.lit(_EMPTY))
    return ended.select(*other.columns).unionAll(other)
