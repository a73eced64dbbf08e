"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratelab.llm.common import attach
from ratelab.scratch import Scratch

MAX_ROUNDS = 100


def _toward_smallest(pairs: DataFrame, larger_only: bool, scratch: Scratch, name: str) -> DataFrame:
    """Link each node's neighbours (``b``) to the smallest of them and the node (``a``)."""
    pairs = scratch.keep(pairs, name)
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.count(F.lit(1)).alias("degree"))
    linked = attach(pairs, least, ["a"], "degree", pairs.count())
    if larger_only:
        return linked.filter("b > a").select("b", F.col("least").alias("a")).distinct()
    both = linked.select(F.col("b"), F.col("least")).union(least.select("a", "least"))
    return both.filter("b != least").select("b", F.col("least").alias("a")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``): root is the smallest node it reaches.

    Rounds of linking to the smallest neighbour, first over larger neighbours,
    then over smaller ones (Kiveris et al., 2014), until nothing changes. Each
    round is stored, so a lost executor costs one round at most. Null ends and
    self links are ignored.
    """
    links = links.filter("a != b").select("a", "b").distinct()
    state = scratch.keep(links, "links")
    if state.isEmpty():
        return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    for turn in range(MAX_ROUNDS):
        both = state.select("a", "b").unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _toward_smallest(both, True, scratch, f"large{turn}")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
        small = _toward_smallest(down, False, scratch, f"small{turn}")
        state = scratch.keep(small.select("a", "b"), f"round{turn}")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # Settled, every link goes from a node to the smallest one of its component.
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        state.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
