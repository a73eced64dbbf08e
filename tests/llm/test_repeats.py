"""Runs against brute force over all periods and places."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ratelab.llm import repeats
from ratelab.llm.repeats import dropped, find_runs, mismatch, periodic_runs

PRIME = 3 * 2**30 + 1


def plain(words, least=12):
    """Every maximal stretch of every period, kept for its smallest period."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def codes(words):
    return np.unique(np.array(list(words)), return_inverse=True)[1]


def test_mismatch_is_exact():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, PRIME, (5, 8), dtype=np.uint64)
    windows = rng.integers(0, PRIME, (5, 23), dtype=np.uint64)
    windows[2, 7:15] = blocks[2]
    want = [
        [sum((int(a) - int(b)) ** 2 for a, b in zip(x, y[t : t + 8])) % PRIME for t in range(16)]
        for x, y in zip(blocks, windows)
    ]
    assert mismatch(blocks, windows).tolist() == want and want[2][7] == 0


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize(
    "words",
    ["", "a", "ab" * 3, "a" * 11, "a" * 12, "a" * 500, "ab" * 200, "abc" * 5 + "abd" * 5, fibonacci(400), "abcdefg" * 3 + "x" + "abcdefg" * 2,
     "".join("ab"[bin(i).count("1") % 2] for i in range(512)), "abcab" * 20 + "abcabx" * 9 + "a" * 30],
)
def test_made_words(words):
    assert find_runs(codes(words)) == plain(words)


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_random(letters):
    rng = random.Random(letters)
    for _ in range(60):
        words = []
        while len(words) < rng.randint(1, 300):
            root = [rng.randrange(letters) for _ in range(rng.randint(1, 40))]
            words += (root * rng.randint(1, 6))[: rng.randint(1, 200)]
        assert find_runs(codes(words)) == plain(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120))
def test_any(words):
    assert find_runs(codes(words)) == plain(words)


def test_slabs(monkeypatch):
    """Blocks of one scale in several slabs give the same runs."""
    words = "".join(random.Random(1).choice("ab") for _ in range(300)) + "abcd" * 40
    monkeypatch.setattr(repeats, "_SLAB", 64)
    assert find_runs(codes(words)) == plain(words)


def test_long_period():
    root = list(range(30_000))
    assert find_runs(np.array(root * 3 + [7, 8])) == [(0, 90_000, 30_000)]


def test_dropped():
    assert dropped(14, [(1, 12, 2)]).tolist() == [i >= 3 and i < 13 for i in range(14)]


def test_texts(spark):
    long = " ".join(f"w{i}" for i in range(70_000)) + " x y" * 20
    rows = [
        (1, "a b " * 10), (1, "a b " * 10), (None, None), (2, ""), (3, " \t\n"), (4, long), (5, "ü ü " * 13 + "ende"),
        (2**60 + 1, "one\ttwo\nthree " * 7 + "four"), (6, "a b " * 3),
    ]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, runs int, n_words int")
    got = periodic_runs(df).collect()
    assert len(got) == len(rows)
    for (doc, text), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r["doc_id"], dict(rows).get(r["doc_id"]))))):
        words = (text or "").encode().split()
        if len(words) < 1000:
            runs = plain(words)
            assert [tuple(x) for x in r["runs"]] == runs
            keep = [w.decode() for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
            assert r["collapsed"] == " ".join(keep)
        assert r["n_words"] == len(words) and r["doc_id"] == doc
    assert [tuple(x) for r in got if r["doc_id"] == 4 for x in r["runs"]] == [(70_000, 40, 2)]
    assert periodic_runs(df.limit(0)).count() == 0
