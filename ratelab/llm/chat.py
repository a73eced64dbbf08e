"""Chat formatting with collapse of cumulative snapshots, in DataFrame operations only.

A chat log that stores the whole conversation after each exchange holds every
conversation many times over, as prefixes of the longest. Rolling hashes of
turn prefixes find them, an anti-join leaves the maximal ones, and these are
rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratelab.scratch import Scratch

# The widely used markup of turns; ``{role}`` and ``{text}`` are filled in.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")
_DIGITS = 15  # hexadecimal digits of a digest in one addend


def _addend(part: int) -> Column:
    """A number from the digest of a turn and its place; different turns or places differ."""
    of = lambda c, tag: F.coalesce(F.concat(F.lit(tag), F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("n"))
    digest = F.sha2(F.concat(F.col("pos").cast("string"), of("role", "r"), of("text", "t")), 256)
    return F.conv(F.substring(digest, 1 + part * _DIGITS, _DIGITS), 16, 10).cast("decimal(20,0)")


def snapshots(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per conversation: ``key, conv_id, turns`` (array in order)."""
    row = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id())
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), row.alias("alone"),
        F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.select(F.monotonically_increasing_id().alias("key"), "conv_id", "turns")


def prefix_hashes(convs: DataFrame) -> DataFrame:
    """``key, conv_id, pos, n, h0..h3`` per turn: the hash of a prefix is that of the one before plus the new turn's."""
    each = convs.select("key", "conv_id", F.size("turns").alias("n"), F.posexplode("turns").alias("i", "t"))
    each = each.select("key", "conv_id", "n", (F.col("i") + 1).alias("pos"), "t.role", "t.text")
    each = each.select("key", "conv_id", "n", "pos", *[_addend(p).alias(f"a{p}") for p in range(4)])
    rolling = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("key", "conv_id", "n", "pos", *[F.sum(f"a{p}").over(rolling).alias(f"h{p}") for p in range(4)])


def maximal(hashes: DataFrame) -> DataFrame:
    """``key, copies`` of conversations that no longer one starts with; of equal ones the smallest id stays.

    Both sides of the anti-join hold each prefix once, combined before the
    shuffle, so a first turn or conversation that a third of all share is one row.
    """
    prefix = ["pos", "h0", "h1", "h2", "h3"]
    first = F.min(F.struct(F.isnull("conv_id").alias("none"), F.col("conv_id"), F.col("key")))
    whole = hashes.filter("pos = n").groupBy(*prefix).agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    proper = hashes.filter("pos < n").select(*prefix).distinct()
    return whole.join(proper, prefix, "left_anti").select("first.key", "copies")


def render(turns: Column, template: tuple[str, str, str] = TEMPLATE) -> Column:
    open_, middle, close = map(F.lit, template)
    empty = F.lit("")
    return F.array_join(
        F.transform(turns, lambda t: F.concat(open_, F.coalesce(t["role"], empty), middle, F.coalesce(t["text"], empty), close)), ""
    )


def format_chats(
    conversations: DataFrame, scratch: Scratch, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", template: tuple[str, str, str] = TEMPLATE,
) -> DataFrame:
    """``conv_id, n_turns, copies, chat`` of every maximal conversation.

    Turns are in order of ``turn`` (null first), repeated numbers by role and
    text. Conversations are equal, or one a prefix of another, by role and
    text of their turns; null differs from empty there, and renders as empty.
    Of equal ones the smallest id stays; ``copies`` counts them. A turn whose
    conversation id is null is a conversation of its own. An empty table gives
    an empty result. Other columns are not read, whatever their names.
    """
    convs = scratch.keep(snapshots(conversations, conv_id, turn, role, text), "snapshots")
    stay = maximal(scratch.keep(prefix_hashes(convs), "prefixes"))
    return convs.join(stay, "key").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", render(F.col("turns"), template).alias("chat")
    )
