"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A table turns vectors by a fast pseudo-rotation (three rounds of random signs
and a Hadamard transform) and files each under its nearest signed axis. A query
also looks under the next nearest axes. What it meets is scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from ratelab.llm.common import attach, parts
from ratelab.scratch import Scratch

TABLES = 8  # and one more each time the buckets of a table double
BUCKET = 512  # vectors that further rotations leave in a bucket, about, at most
PROBED = 4096  # vectors that a table's probes are to meet, about (all, if fewer), at every size
FILED = 1024  # vectors filed at a time
SIDE = 4096  # vectors of a bucket scored as one block
BIN_ROWS = 20_000
SEED = 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        pairs = x.reshape(n, -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def rotate(x: np.ndarray, table: int, step: int, width: int) -> np.ndarray:
    """Pseudo-rotation of ``table``; the same in every task."""
    rng = np.random.default_rng([SEED, table, step, width])
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    for _ in range(3):
        out = hadamard(out * rng.choice([-1.0, 1.0], width))
    return out


def axis_order(turned: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` nearest signed axes of each row, nearest first, and how far they fall behind the nearest."""
    signed = np.concatenate([turned, -turned], axis=1)
    order = np.argsort(-signed, axis=1, kind="stable")[:, :n]
    values = np.take_along_axis(signed, order, axis=1)
    return order, (values[:, :1] - values) ** 2


class Plan:
    """``tables`` for vectors of ``dims`` numbers, and how many buckets (``probes``) a query looks under in each.

    The nearest axis of one rotation names a bucket; beyond BUCKET vectors a
    bucket, those of further rotations (``second``, then ``more`` axes) join the
    name. So buckets keep their size, and probes their number, at any ``n``.
    """

    def __init__(self, n: int, dims: int, lift: float | None):
        self.lift = lift  # largest norm, where norms differ
        self.width = 1 << max(0, (dims + (lift is not None) - 1).bit_length())
        self.axes, self.tables, self.more = 2 * self.width, TABLES, []
        while n > BUCKET * self.axes:
            if not self.more or self.more[-1] == self.width:
                self.more.append(1)
            else:
                self.more[-1] *= 2
            self.axes *= 2
            self.tables += 1
        self.probes = min(self.axes, max(1, math.ceil(self.axes * PROBED / max(1, n))))

    @property
    def second(self) -> int:
        return self.more[0] if self.more else 0

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """With one more coordinate the largest inner product is the smallest angle, whatever the norms."""
        if self.lift is None:
            return x
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.lift**2 - (x * x).sum(axis=1)))
        return np.column_stack([x, more])

    def codes(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The ``probes`` nearest buckets of each row in ``table``."""
        code, far = axis_order(rotate(x, table, 0, self.width), min(probes, 2 * self.width))
        for step, wide in enumerate(self.more, 1):
            other, behind = axis_order(rotate(x, table, step, self.width)[:, :wide], min(probes, 2 * wide))
            both = (far[:, :, None] + behind[:, None, :]).reshape(len(x), -1)
            best = np.argsort(both, axis=1, kind="stable")[:, :probes]
            own, added = best // other.shape[1], best % other.shape[1]
            code = np.take_along_axis(code, own, axis=1) * (2 * wide) + np.take_along_axis(other, added, axis=1)
            far = np.take_along_axis(both, best, axis=1)
        return code


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, keep: int, every: int) -> DataFrame:
    """``vector, ids, size, asks`` per distinct vector: the ``keep`` smallest ids, the number of rows, any query among them.

    Smallest ids are combined in three steps (part of the table, 1,024 parts,
    all), so a vector in a third of all rows never gathers its rows in a task.
    """
    found = rows.select("vector", F.array("id").alias("ids"), F.lit(1).cast("long").alias("size"), (F.col("id") % every == 0).alias("asks"), F.shiftright(F.monotonically_increasing_id(), 33).alias("part"))
    for shift in (0, 10, 62):
        salted = found.withColumn("part", F.shiftright("part", shift))
        found = salted.groupBy("vector", "part").agg(
            F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"), F.sum("size").alias("size"),
            F.max("asks").alias("asks"),
        )
    return found.select("vector", "ids", "size", "asks")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), float)


def _filed(vectors: DataFrame, plan_of: dict[int, Plan], query: bool) -> DataFrame:
    """``dims, tab, code, vid``: one row per table (and probe, for queries) and vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, own in batch.groupby(batch["vector"].map(len)):
                plan = plan_of[dims]
                for a in range(0, len(own), FILED):
                    some = own.iloc[a : a + FILED]
                    at = plan.lifted(_matrix(some["vector"]), query)
                    for t in range(plan.tables):
                        codes = plan.codes(at, t, plan.probes if query else 1)
                        vid = np.repeat(some["vid"].to_numpy(), codes.shape[1])
                        yield pd.DataFrame({"dims": dims, "tab": t, "code": codes.ravel(), "vid": vid})

    return vectors.select("vid", "vector").mapInPandas(run, "dims int, tab int, code long, vid long")


PAIRS = 1 << 16  # pairs scored again at a time


def nearest_of_block(q: np.ndarray, v: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, score``: the ``k`` rows of ``v`` nearest to each row of ``q``, ties to the smaller ``first``."""
    if len(v) > k:
        s = q @ v.T
        least = np.partition(s, len(v) - k, axis=1)[:, len(v) - k]
        # The product's last bits differ between blocks; all that may reach the k-th exact score are scored again.
        slack = 4 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
        least = least - slack
        i, j = np.nonzero(s >= np.where(np.isfinite(least), least, -np.inf)[:, None])
    else:
        i, j = np.repeat(np.arange(len(q)), len(v)), np.tile(np.arange(len(v)), len(q))
    # Row by row: equal pairs get equal numbers in every block.
    score = np.concatenate([(q[i[a : a + PAIRS]] * v[j[a : a + PAIRS]]).sum(axis=1) for a in range(0, len(i), PAIRS)])
    if len(i) > k * len(q):
        order = np.lexsort((first[j], -score, i))
        begin = np.searchsorted(i, np.arange(len(q)))
        order = order[np.arange(len(i)) - begin[i] < k]
        i, j, score = i[order], j[order], score[order]
    return i, j, score


KEY = ["dims", "tab", "code"]


def _met(index: DataFrame, probes: DataFrame, vectors: DataFrame, scratch: Scratch, k: int, name: str) -> DataFrame:
    """``qvid, far, first, vid``: the ``k`` nearest, and more, of the vectors that each query meets.

    ``index`` and ``probes`` (``dims, tab, code, vid``) say who meets whom. A
    bucket is scored in blocks of SIDE vectors and SIDE queries, each with
    each; vectors are looked up once for every block they are in.
    """
    sizes = index.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    asked = probes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("asked"))
    sizes = sizes.join(asked, KEY).withColumns({
        "blocks": F.ceil(F.col("n") / SIDE).cast("int"), "turns": F.ceil(F.col("asked") / SIDE).cast("int")
    })
    sizes = scratch.keep(sizes, f"{name}_sizes")
    totals = sizes.agg(F.sum("n"), F.sum("asked"), F.sum(F.col("n") * F.col("turns") + F.col("asked") * F.col("blocks"))).first()
    n_index, n_asked, n_copies = (int(x or 0) for x in totals)
    part = lambda c: F.pmod(F.xxhash64("vid"), c).cast("int")
    every_one = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    there = attach(index, sizes, KEY, "n", n_index).withColumn("block", part("blocks")).withColumn("turn", every_one("turns"))
    here = attach(probes, sizes, KEY, "asked", n_asked).withColumn("turn", part("turns")).withColumn("block", every_one("blocks"))
    columns = [*KEY, "block", "turn", "vid"]
    both = there.select(*columns, F.lit(False).alias("asks")).unionByName(here.select(*columns, F.lit(True).alias("asks")))
    bins = parts(n_copies, BIN_ROWS)
    both = both.withColumn("bin", F.pmod(F.xxhash64(*KEY, "block", "turn"), F.lit(bins)).cast("int"))
    # In a bin a vector of several buckets is looked up, and sent, once.
    both = both.groupBy("bin", "vid").agg(F.collect_list(F.struct(*KEY, "block", "turn", "asks")).alias("places"))
    both = both.join(vectors.select("vid", "first", "vector"), "vid")

    def score(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        counts = group["places"].map(len).to_numpy()
        places = pd.DataFrame([tuple(p.values()) for own in group["places"] for p in own], columns=[*KEY, "block", "turn", "asks"])
        places["at"] = np.repeat(np.arange(len(group)), counts)
        vids, first, out = group["vid"].to_numpy(), group["first"].to_numpy(), []
        for _, own in places.groupby([*KEY, "block", "turn"]):
            asks, at = own["asks"].to_numpy(bool), own["at"].to_numpy()
            if asks.all() or not asks.any():
                continue
            there, here = at[~asks], at[asks]
            v = _matrix(group["vector"].iloc[there])
            for a in range(0, len(here), 1024):
                some = here[a : a + 1024]
                i, j, found = nearest_of_block(_matrix(group["vector"].iloc[some]), v, first[there], k)
                out.append(pd.DataFrame({"qvid": vids[some[i]], "far": -found, "first": first[there[j]], "vid": vids[there[j]]}))
        if not out:
            return pd.DataFrame({"qvid": [], "far": [], "first": [], "vid": []})
        # Equal pairs have equal scores, so a pair met in several tables is one row.
        best = pd.concat(out).drop_duplicates(["qvid", "vid"]).sort_values(["qvid", "far", "first"])
        return best.groupby("qvid").head(k)

    return both.groupBy("bin").applyInPandas(score, "qvid long, far double, first long, vid long")


def _lists(hits: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``qvid, list``: the ``k`` nearest rows met, as (far, other); a query that meets nothing is left out."""
    # At most k rows per query and bin come here.
    best = hits.groupBy("qvid").agg(F.slice(F.sort_array(F.collect_set(F.struct("far", "first", "vid"))), 1, k).alias("best"))
    pairs = best.select("qvid", F.explode("best").alias("b")).select("qvid", "b.far", "b.vid")
    pairs = pairs.join(found.select("vid", "ids"), "vid").select("qvid", "far", F.explode("ids").alias("other"))
    return pairs.groupBy("qvid").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "other"))), 1, k).alias("list"))


def nearest(
    vectors: DataFrame, scratch: Scratch, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id ``every`` divides.

    Score: inner product in double precision; nearest first, ties to smaller
    ids, the query's own row left out. Vectors that are null, empty or zero,
    or hold null or non-finite components, take no part, nor do rows with null
    ids. Vectors of different lengths never meet. Equal vectors are searched
    once, so a very common one costs no more than a rare one. A query whose
    probes meet fewer than ``k`` other rows is searched in all rows. An empty table
    gives an empty result; repeated ids are rows of their own. Other columns
    are not read.
    """
    # Floats stay floats wherever they are stored or sent; doubles are made of them to compute.
    kind = "array<float>" if vectors.select(embedding).schema[0].dataType == ArrayType(FloatType(), True) else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(kind).alias("vector"))
    # Grouping takes -0.0 and 0.0 for one value, and so does an inner product.
    rows = scratch.keep(rows.filter(F.col("id").isNotNull() & usable("vector")), "vectors")
    found = distinct_vectors(rows, k + 1, every).withColumn("vid", F.monotonically_increasing_id())
    # Ties between vectors go to the one with the smallest id, wherever vectors are cut off.
    found = found.withColumn("first", F.element_at("ids", 1))
    found = scratch.keep(found, "distinct")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    stats = found.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)), F.min(norm), F.max(norm), F.sum("size")).collect()
    plan_of = {dims: Plan(n, dims, high if high > 1.001 * low else None) for dims, n, low, high, _ in stats}
    queries = found.filter("asks")
    index = scratch.keep(_filed(found, plan_of, False), "index")
    probes = scratch.keep(_filed(queries, plan_of, True), "probes")
    # k + 1 rows hold the k nearest of every query with this vector, itself left out.
    lists = _lists(_met(index, probes, found, scratch, k + 1, "probed"), found, k + 1)
    lists = queries.select(F.col("vid").alias("qvid"), "vector", "size").join(lists, "qvid", "left")
    there = F.lit(0)
    for dims, _, _, _, total in stats:
        there = F.when(F.size("vector") == dims, F.lit(min(total, k + 1))).otherwise(there)
    lists = lists.withColumn("short", F.coalesce(F.size("list"), F.lit(0)) < there)
    lists = scratch.keep(lists, "lists")
    short = lists.filter("short").select("qvid", "vector", "size")
    if not short.isEmpty():
        # Their probes met too few rows: each goes through all vectors of its length, in blocks.
        whole = lambda of, vid: of.select(F.size("vector").alias("dims"), F.lit(0).alias("tab"), F.lit(0).cast("long").alias("code"), F.col(vid).alias("vid"))
        again = _met(whole(found, "vid"), whole(short, "qvid"), found, scratch, k + 1, "whole")
        again = short.join(_lists(again, found, k + 1), "qvid")
        lists = scratch.keep(lists.filter(~F.col("short")).select(*again.columns).unionByName(again), "completed")
    lists = lists.select("vector", "size", "list")
    asked = attach(rows.filter(F.col("id") % every == 0), lists, ["vector"], "size", rows.count())
    # One entry of the query's own row goes, not those of other rows with its id.
    mine = F.array_position(F.transform("list", lambda x: x["other"]), F.col("id"))
    others = F.when(mine == 0, F.col("list")).otherwise(
        F.filter("list", lambda x, i: i + 1 != mine)
    )
    ranked = asked.select("id", F.posexplode(F.slice(others, 1, k)).alias("i", "x"))
    return ranked.select(
        F.col("id").alias("query_id"), (F.col("i") + 1).alias("rank"), F.col("x.other").alias("vec_id"), (-F.col("x.far")).alias("score")
    )
