"""The trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ratelab.llm.turn_trie import common_turns, ends_digest, sequences, share_openings, turn_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, rebuild):
    """Rows of the trie by walking every prefix of every conversation."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest[:32], role, text))
    convs = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    if rebuild:
        base = convs
        convs = {}
        for c, own in base.items():
            h = zlib.crc32(str(c).encode()) % 6
            rest = int(abs(c) % 100) * (1 if c >= 0 else -1)
            convs[c] = base.get(c - rest, [])[:h] + own[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def found(spark, scratch, rows, rebuild, ranges):
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seqs = sequences(df)
        seqs = scratch.keep(share_openings(seqs) if rebuild else seqs, "seqs")
        nodes = ends_digest(seqs, turn_trie(seqs, scratch), scratch)
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        return sorted(tuple(r[c] for c in names) for r in nodes.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def drawn(seed, convs, letters, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c * 7 % 1000, t, rng.choice(["user", "assistant"]) if t % 3 else "user", rng.choice(letters) * rng.randint(1, 2)))
    return rows


def test_common_turns():
    a, b = bytes(range(64)), bytes(range(48)) + bytes(16)
    assert common_turns(a, b) == 3 and common_turns(a, a[:32]) == 2 and common_turns(b"", a) == 0


@pytest.mark.parametrize("ranges", [1, 2, 11])
@pytest.mark.parametrize("rebuild", [False, True])
def test_against_plain(spark, scratch, rebuild, ranges):
    rows = drawn(3, 150, "ab", 6)
    assert found(spark, scratch, rows, rebuild, ranges) == plain(rows, rebuild)


def test_copies_prefixes_and_long(spark, scratch):
    rows = []
    for c in range(120):  # a third are copies, some prefixes of one another
        for t in range(c % 4 if c % 3 else 3):
            rows.append((c, t, "user", "same"))
    rows += [(500 + i, t, "user", f"turn {t}") for i in range(3) for t in range(400 + 50 * i)]
    rows += [(900, 0, "user", "x" * 200_000)]
    for ranges in (1, 5):
        assert found(spark, scratch, rows, False, ranges) == plain(rows, False)


def test_nulls_ties_and_repeats(spark, scratch):
    rows = [
        (1, None, "user", "null turn first"), (1, 0, None, "no role"), (1, 0, "user", None), (1, 0, "user", None),
        (2, 5, "", ""), (2, 3, "", ""), (-3, 1, "user", "negative"), (-103, 1, "user", "negative"), (None, 0, "user", "no id"),
        (100, 0, "ab", "c"), (200, 0, "a", "bc"), (205, 0, "a", "bc"), (205, 1, "a", "bc"),
    ]
    for rebuild in (False, True):
        assert found(spark, scratch, rows, rebuild, 3) == plain(rows, rebuild)


def test_empty_table(spark, scratch):
    assert found(spark, scratch, [], True, 3) == []


def test_clashing_columns(spark, scratch):
    rows = drawn(5, 20, "ab", 3)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", seq int, part int, path int")
    seqs = scratch.keep(share_openings(sequences(df)), "extra")
    assert turn_trie(seqs, scratch).count() == len(plain(rows, True))
