"""Quality classifier: hashed word n-grams, logistic regression, follow the regularised leader.

Lower-cased words give 1-, 2- and 3-grams; their shapes (case, digits,
punctuation, repetition of the word before) give as many further features. Each
is hashed to one of 2**BITS weights. The weights are
learnt with FTRL-proximal updates on a bounded sample of labelled rows, and a
score is a sparse dot product over the whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ratelab.llm.common import words_in_chunks

BITS = 18
SAMPLE = 12_000  # labelled rows learnt from, at most
SHARDS = 4  # learnt side by side, weights averaged
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
_MEMO = 150_000  # words a worker remembers, at most, and only during a task
_MASK = np.uint64((1 << BITS) - 1)
_SAME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_known: dict[bytes, int] = {}


def _word(word: bytes) -> int:
    """Hash of the lower-cased word (high half) and of its shape (low half)."""
    text = word.decode("utf-8", "replace")
    shape, last = [], ""
    for c in text:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if kind != last:
            shape.append(kind)
            last = kind
    return zlib.crc32(text.lower().encode()) << 31 | zlib.crc32("".join(shape).encode()) >> 1


def _codes(words: list[bytes]) -> np.ndarray:
    try:
        codes = list(map(_known.__getitem__, words))
    except KeyError:
        if len(_known) > _MEMO:
            _known.clear()
        for w in words:
            if w not in _known:
                _known[w] = _word(w)
        codes = list(map(_known.__getitem__, words))
    return np.array(codes, np.uint64)


def _slot(hashes: np.ndarray, salt: int) -> np.ndarray:
    mixed = (hashes ^ np.uint64(salt * 0x51_7CC1_B727)) * _MIX
    return ((mixed ^ (mixed >> np.uint64(29))) * _SAME >> np.uint64(64 - BITS)) & _MASK


def features(text: str | None) -> Iterator[np.ndarray]:
    """Slots of all n-grams of the text, repeats included, some at a time.

    Per word: the 1-, 2- and 3-grams of words, and those of shapes, that end at it.
    """
    carried = 0
    for words in words_in_chunks((text or "").encode("utf-8", "surrogatepass"), 3):
        codes = _codes(words)
        if not len(codes):
            continue
        word, shape = codes >> np.uint64(31), codes & np.uint64(0x7FFFFFFF)
        same = np.r_[False, word[1:] == word[:-1]]
        shape = np.where(same, shape ^ _SAME, shape) * _MIX
        # Words carried over stand for context only.
        new, carried = carried, min(3, len(words))
        grams = (*_grams(word * _MIX), *_grams(shape))
        yield np.concatenate([_slot(x[new:], i + 1) for i, x in enumerate(grams)]).astype(np.int64)


def _grams(one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the 1-, 2- and 3-grams that end at each place; order counts."""
    two = np.r_[one[:1], one[1:] ^ (one[:-1] * np.uint64(3))]
    three = np.r_[two[:2], two[2:] ^ (one[:-2] * np.uint64(5))]
    return one, two, three


def dot(text: str | None, weights: np.ndarray) -> float:
    """Weights times n-gram shares of the text; 0 without words."""
    total, n = 0.0, 0
    for slots in features(text):
        total += float(weights[slots].sum())
        n += len(slots)
    return total / n if n else 0.0


def _sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    counts: dict[int, int] = {}
    for slots in features(text):
        for s, c in zip(*(x.tolist() for x in np.unique(slots, return_counts=True))):
            counts[s] = counts.get(s, 0) + c
    slots = np.fromiter(counts, np.int64, len(counts))
    values = np.fromiter(counts.values(), np.float64, len(counts))
    return slots, values / max(1.0, values.sum())


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights (the last one is the intercept) after EPOCHS passes of FTRL-proximal updates."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        w = (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            slots, values = examples[i]
            at, x = np.r_[slots, size - 1], np.r_[values * _SCALE, 1.0]
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - labels[i]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(size))


_SCALE = 40.0  # shares of a text are small; updates of one word's weight should not be


def held_out(doc_id: str) -> Column:
    """Whether a row is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray | None:
    """Weights learnt from at most ``sample`` labelled rows that are not held out; None without any.

    The sample is by a hash of the id, so it is spread over all rows. A
    repeated label counts once (the smallest), and so does a repeated id.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(doc_id) & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        w = ftrl([_sparse(t) for t in group["text"]], group["quality"].to_numpy(float))
        at = np.flatnonzero(w)
        at = at if len(at) else np.array([len(w) - 1])
        return pd.DataFrame({"slot": at, "weight": w[at], "rows": len(group)})

    learnt = rows.groupBy(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(SHARDS)).alias("shard")).applyInPandas(
        learn, "slot long, weight double, rows long"
    )
    # At most SHARDS * 2**BITS rows come to the driver.
    found = learnt.groupBy("slot").agg(F.sum(F.col("weight") * F.col("rows")).alias("w"), F.max("rows")).collect()
    if not found:
        return None
    weights = np.zeros((1 << BITS) + 1)
    total = sum(r["rows"] for r in rows.groupBy(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(SHARDS))).agg(F.count(F.lit(1)).alias("rows")).collect())
    for r in found:
        weights[r["slot"]] = r["w"] / total
    return weights


def score(text: str, weights: np.ndarray | None) -> Column:
    """Score of a text column, 0 to 1. Without weights nothing speaks against a text: 1."""
    if weights is None:
        return F.lit(1.0)
    own = weights[:-1].astype(np.float32)
    intercept = float(weights[-1])

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            dots = np.array([dot(t, own) for t in texts], float)
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(_SCALE * dots + intercept, -700, 700))))
        # Workers live on; what they remember would add to later stages.
        _known.clear()

    return of(F.col(text).cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts have no n-grams and get the intercept's score. Only
    ids and texts are read; labels serve learning alone. Repeated rows are
    scored alike; an empty table gives an empty result.
    """
    weights = train(docs, labels, doc_id, text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), score(text, weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least THRESHOLD, with all their columns."""
    return docs.filter(score(text, train(docs, labels, doc_id, text)) >= THRESHOLD)
