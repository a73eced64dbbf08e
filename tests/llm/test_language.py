"""Sums over segmentations against listing them; predictions on texts of known language."""

import itertools
import random
import zlib

import numpy as np
import pytest

from ratelab.llm import language
from ratelab.llm.encoding import vocabulary
from ratelab.llm.language import Segmenter, Vocabulary, identify, learn, totals

PIECES = ["▁", "a", "b", "ab", "ba", "▁a", "aba", "▁ab", "c", "<0x41>", "A", "1", "a1"]


@pytest.fixture(scope="module")
def small():
    return Vocabulary(PIECES)


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def drawn(vocabulary, languages=2, seed=0):
    p = np.random.default_rng(seed).random((vocabulary.size, languages))
    return np.log(p / p.sum(axis=0))


def chance(parts, vocabulary, logs, k):
    total = 0.0
    for p in parts:
        own = [vocabulary.index[p]] if p in vocabulary.index else [vocabulary.letters + b for b in p.encode()]
        total += sum(logs[i, k] for i in own)
    return np.exp(total)


def test_vocabulary(small):
    assert set(small.index) == {"▁", "a", "b", "ab", "ba", "▁a", "aba", "▁ab", "c"} and small.longest == 3
    full = Vocabulary.load(vocabulary("piece_bpe_32k.model"))
    assert full.size > 10_000 and all(p == p.lower() for p in full.index)


def test_forward(small):
    logs = drawn(small)
    words = ["▁" + "".join(w) for n in range(1, 6) for w in itertools.product("abcé", repeat=n)]
    got = Segmenter(small, logs).score(words)
    for w, row in list(zip(words, got))[::7]:
        want = [sum(chance(s, small, logs, k) for s in segmentations(w, small.index)) for k in range(2)]
        assert np.allclose(np.exp(row), want)


def test_expected_counts(small):
    logs = drawn(small, 1)
    words, counts = ["▁abab", "▁a", "▁éab", "▁bcaba"], np.array([3.0, 1.0, 2.0, 5.0])
    want = np.zeros(small.size)
    for w, n in zip(words, counts):
        every = list(segmentations(w, small.index))
        each = [chance(s, small, logs, 0) for s in every]
        for s, c in zip(every, each):
            for p in s:
                for i in [small.index[p]] if p in small.index else [small.letters + b for b in p.encode()]:
                    want[i] += n * c / sum(each)
    assert np.allclose(Segmenter(small, logs).expect(words, counts), want)


def test_long_word_does_not_underflow(small):
    score = Segmenter(small, drawn(small)).score(["▁" + "ж" * 5000, "▁ab"])
    assert np.isfinite(score).all() and (score[0] < -5000).all()


def test_parts_of_a_text_add_up(small, monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(300))
    whole = totals([text, None, "ab"], Segmenter(small, drawn(small)))
    monkeypatch.setattr(language, "_CHARS", 64)
    parts = totals([text, None, "ab"], Segmenter(small, drawn(small)))
    assert np.allclose(whole[0], parts[0]) and whole[1].tolist() == parts[1].tolist() == [300, 0, 1]


def test_predictions(spark, scratch):
    rng = random.Random(4)
    letters = {"en": "theandofingr", "xx": "zxqwkyvjpoua", "": "éèàçôleduns"}
    rows = []
    for i in range(600):
        lang = rng.choice(list(letters))
        words = ["".join(rng.choices(letters[lang], k=rng.randint(2, 8))) for _ in range(rng.randint(3, 40))]
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words), lang, "s"))
    want = {r[0]: r[2] for r in rows}
    rows += [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 _ ²!", "en", "s"), (None, "the hand", "xx", "s"), (None, "the hand", None, "s")]
    rows += [(1003, "the hand of " * 100_000, None, "s"), (7, rows[7][1], rows[7][2], "s")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, score int")
    own = Vocabulary.load(vocabulary("piece_bpe_32k.model"))
    got = identify(df, own, scratch).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    held = [i for i in want if by_id[i]["held_out"]]
    assert len(held) > 100 and sum(by_id[i]["lang_pred"] == want[i] for i in held) > 0.98 * len(held)
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by_id[None]["lang_pred"] == by_id[1003]["lang_pred"] == "en" and by_id[1003]["score"] == 1.0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_and_other_columns_do_not_teach(spark, scratch):
    own = Vocabulary.load(vocabulary("piece_bpe_32k.model"))
    rows = [(i, "the hand", "en" if zlib.crc32(str(i).encode()) % 4 != 2 else "held") for i in range(40)] + [(None, "le main", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert learn(df, own, scratch, rounds=1).languages == ["en"]


def test_nothing_to_learn(spark, scratch):
    df = spark.createDataFrame([(1, "the hand", None), (2, None, "en")], "doc_id long, text string, lang string")
    own = Vocabulary.load(vocabulary("piece_bpe_32k.model"))
    assert {(r["lang_pred"], r["score"]) for r in identify(df, own, scratch).collect()} == {("und", 0.0)}
    assert identify(df.limit(0), own, scratch).count() == 0
