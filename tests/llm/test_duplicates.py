import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from ratelab.llm import blocknames, simhash
from ratelab.llm.blocknames import drop_exact_duplicates, exact_duplicates
from ratelab.llm.components import components
from ratelab.llm.simhash import bit_groups, close_classes, drop_near_duplicates, fingerprint, near_duplicates

SCHEMA = "doc_id long, text string, lang string, row string, name string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], SCHEMA)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if normal(u) == normal(t)]
        ids = [j for j in same if j is not None]
        out.append((i, min(ids) if ids else None, len(same)))
    return sorted(out, key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 40))) for _ in range(12)]
    return [rng.choice(base) + rng.choice(["", "", "\n", " x", " "]) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_exact_against_brute_force(spark, scratch, block):
    rows = list(enumerate(texts(120, 1))) + [(None, None), (7, ""), (None, "a"), (3, "a"), (3, "a")]
    got = exact_duplicates(frame(spark, rows), scratch, block=block).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=repr) == brute_exact(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({normal(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_hot_contents_and_hash_collisions(spark, scratch, monkeypatch):
    # Few buckets: most contents share one, so only sorting tells them apart.
    monkeypatch.setattr(blocknames, "_BUCKETS", 3)
    monkeypatch.setattr(blocknames, "HOT_SHARE", 4)
    rows = list(enumerate(["same text, long enough for pairs"] * 80 + texts(60, 2)))
    got = exact_duplicates(frame(spark, rows), scratch, block=4).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size) for r in got], key=repr) == brute_exact(rows)


def test_exact_empty_table_and_whole_rows(spark, scratch):
    assert exact_duplicates(frame(spark, []), scratch).count() == 0
    kept = drop_exact_duplicates(frame(spark, [(2, "a  b"), (1, "a\nb"), (3, None), (4, "c")]), scratch)
    assert kept.columns == ["doc_id", "text", "lang", "row", "name", "block"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_long_text_differs_in_its_last_character(spark, scratch):
    long = "word and " * 30_000
    rows = [(1, long + "x"), (2, long + "y"), (3, long + "x"), (4, long)]
    got = {r.doc_id: r.keep_id for r in exact_duplicates(frame(spark, rows), scratch).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÉ \n\t İx", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) & (2**64 - 1) == brute_print(text)


def test_fingerprint_in_chunks(spark, monkeypatch):
    # Spark's xxhash64 has the same seed, so one shingle can be checked with it.
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    for text in ("", " ", "a", "a b", "a b c", "one two three four five six seven eight", "longwordthatgoeson " * 9):
        assert fingerprint(text) & (2**64 - 1) == brute_print(text)
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == brute_print("a b c")


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_classes(radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([centres, *[c ^ (np.uint64(1) << rng.integers(0, 64, 5, dtype=np.uint64)) for c in centres], *[
        c ^ (np.uint64(1) << rng.integers(0, 64, 9, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 9, dtype=np.uint64)) for c in centres]]))
    unit = np.sort(rng.integers(0, 3, len(prints)))
    want = np.arange(len(prints))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if unit[i] == unit[j] and bin(int(prints[i]) ^ int(prints[j])).count("1") <= radius and want[j] < want[i]:
                    want[i], changed = want[j], True
    assert (close_classes(prints, unit, radius) == want).all()


@pytest.mark.parametrize("n", [1, 10**7, 10**10])
def test_bit_groups_miss_nothing(n):
    masks = [m & (2**64 - 1) for m in bit_groups(n, 3)]
    rng = random.Random(n)
    for _ in range(500):
        differ = sum(1 << k for k in rng.sample(range(64), 3))
        assert any(not m & differ for m in masks)


def brute_components(rows, words=3, radius=3):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(prints[i] ^ prints[j]).count("1") <= radius and root[j] < root[i]:
                    root[i], changed = root[j], True
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((d, f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def near_rows(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(250)] for _ in range(8)]
    rows = []
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    return rows + [(None, None), (500, ""), (None, "a"), (501, "A"), (501, "A"), (502, " ")]


@pytest.mark.parametrize("side", [2048, 3])
def test_near_duplicates_against_brute_force(spark, scratch, monkeypatch, side):
    monkeypatch.setattr(simhash, "SIDE", side)
    rows = near_rows(5)
    got = near_duplicates(frame(spark, rows), scratch).collect()
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=repr) == brute_components(rows)
    heads = [r for r in got if r.row == r.component_row]
    assert len(heads) == len({r.component_id for r in got})


def test_near_duplicates_empty_and_whole_rows(spark, scratch):
    assert near_duplicates(frame(spark, []), scratch).count() == 0
    kept = drop_near_duplicates(frame(spark, [(2, "a b c d"), (1, "A b\nc d"), (3, "quite another text here")]), scratch)
    assert kept.columns == ["doc_id", "text", "lang", "row", "name", "block"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components_of_chains_and_stars(spark, scratch):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 200), (250, 300), (7, 7)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {200: 200, 300: 200, 250: 200}
    assert got == want
