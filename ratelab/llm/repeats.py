"""Maximal periodic runs of words, found by block convolution.

At each dyadic scale a text is cut into blocks, and each block is laid over the
window that follows it at all distances of the scale. The sum of squared
differences of word numbers is zero exactly where the block recurs; it is
computed for all distances at once by a number-theoretic transform, in whole
numbers modulo a prime. A distance found so is a seed: it is proved on the words
and extended both ways to the longest stretch with that period.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LEAST = 12  # words of a run at least
# 3 * 2**30 + 1 is prime, 5 generates its units: transforms up to 2**30 numbers.
_PRIME, _ROOT = np.uint64(3 * 2**30 + 1), 5
_SLAB = 1 << 20  # numbers transformed together
_WORDS = 1 << 19  # words of texts searched together, or one longer text
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


# --- transform -----------------------------------------------------------------------


@lru_cache(maxsize=64)
def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order ``size``."""
    p = int(_PRIME)
    root = pow(_ROOT, (p - 1) // size, p)
    if inverse:
        root = pow(root, p - 2, p)
    out = np.ones(max(size // 2, 1), np.uint64)
    done = 1
    while done < size // 2:
        out[done : 2 * done] = out[:done] * np.uint64(pow(root, done, p)) % _PRIME
        done *= 2
    return out


def _forward(a: np.ndarray) -> np.ndarray:
    """Transform of each row, in bit-reversed order."""
    rows, size = a.shape
    half = size // 2
    while half:
        v = a.reshape(rows, -1, 2, half)
        low, high = v[:, :, 0], v[:, :, 1]
        total = low + high
        apart = low + _PRIME - high
        # Unsigned numbers wrap: the lesser one is the remainder.
        apart = np.minimum(apart, apart - _PRIME) * _powers(2 * half, False) % _PRIME
        a = np.stack([np.minimum(total, total - _PRIME), apart], 2).reshape(rows, size)
        half //= 2
    return a


def _backward(a: np.ndarray) -> np.ndarray:
    """Rows from their transform in bit-reversed order."""
    rows, size = a.shape
    half = 1
    while half < size:
        v = a.reshape(rows, -1, 2, half)
        low, high = v[:, :, 0], v[:, :, 1] * _powers(2 * half, True) % _PRIME
        total, apart = low + high, low + _PRIME - high
        a = np.stack([np.minimum(total, total - _PRIME), np.minimum(apart, apart - _PRIME)], 2).reshape(rows, size)
        half *= 2
    return a * np.uint64(pow(size, int(_PRIME) - 2, int(_PRIME))) % _PRIME


def mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo the prime, of each block with each stretch of its window.

    Numbers are unsigned and below the prime. A sum of zero modulo the prime is a
    necessary condition for equality, which the caller proves.
    """
    width, span = blocks.shape[1], windows.shape[1]
    size = 1 << (width + span - 2).bit_length()
    x, y = np.zeros((2, len(blocks), size), np.uint64)
    x[:, :width] = blocks[:, ::-1]
    y[:, :span] = windows
    cross = _backward(_forward(x) * _forward(y) % _PRIME)[:, width - 1 : span]
    sums = np.cumsum(np.pad(windows * windows % _PRIME, ((0, 0), (1, 0))), axis=1, dtype=np.uint64)
    squares = (sums[:, width:] - sums[:, :-width]) % _PRIME
    own = (blocks * blocks % _PRIME).sum(axis=1, dtype=np.uint64) % _PRIME
    return (own[:, None] + squares + np.uint64(2) * (_PRIME - cross)) % _PRIME


# --- runs ----------------------------------------------------------------------------


def _gaps(codes: np.ndarray) -> np.ndarray:
    """Distance from each word to the next equal one; the length of all if there is none."""
    order = np.argsort(codes, kind="stable")
    out = np.full(len(codes), len(codes), np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    step, at = 64, 0
    while at < len(a):
        differ = a[at : at + step] != b[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at += step
        step *= 2
    return len(a)


def _stretch(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``period`` apart are equal; it ends before the second number."""
    end = at + _reach(codes[at : len(codes) - period], codes[at + period :])
    start = at - _reach(codes[:at][::-1], codes[period : at + period][::-1])
    return start, end + period


def _scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """Block length, and the least and greatest period it is for.

    A run of period q repeats at distance q over at least max(q, 6) places, and
    2 * width - 1 places hold a whole block of the grid.
    """
    width, low, high = 2, 1, 6
    while low <= longest:
        yield width, low, high
        width *= 2
        low, high = 2 * width - 1, 4 * width - 2


def _seeds(codes: np.ndarray, gaps: np.ndarray, width: int, low: int, high: int, settled: np.ndarray) -> Iterator[np.ndarray]:
    """(place, period) of blocks that recur ``low`` to ``high`` words later, some at a time.

    ``settled`` is, per word, the end of a run over it with a period of at most
    ``width`` (0: none). A block can only recur where all its words do. Where
    block and window lie in such a run, all that recurs is the run itself.
    """
    n = len(codes)
    starts = np.arange(0, n - width - low + 1, width)
    far = np.maximum.reduceat(gaps, starts) if len(starts) else starts
    if len(starts):
        # The last group of reduceat runs to the end of the text.
        far[-1] = gaps[starts[-1] : starts[-1] + width].max()
    # Nothing lies beyond the text; past it the window has numbers of no word.
    inside = np.minimum(starts + high + width, n) <= settled[starts]
    starts = starts[(far <= high) & ~inside]
    span = high - low + width
    padded = np.concatenate([codes, np.full(high + width, codes.max() + 1, np.uint64)]) if len(starts) else codes
    size = 1 << (width + span - 2).bit_length()
    some = max(1, _SLAB // size)
    for k in range(0, len(starts), some):
        part = starts[k : k + some]
        blocks = padded[part[:, None] + np.arange(width)]
        windows = padded[part[:, None] + low + np.arange(span)]
        row, shift = np.nonzero(mismatch(blocks, windows) == 0)
        if not len(row):
            continue
        place, period = part[row], shift + low
        # A first look at one word; the rest is proved when the seed is extended.
        here = padded[place] == padded[place + period]
        yield np.stack([place[here], period[here]], 1)


def find_runs(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all maximal runs of a sequence of word numbers, by start, then period.

    A run is a stretch of at least max(``least``, 2 * period) words in which
    words a period apart are equal, for its smallest period, that no neighbour
    extends. ``least`` is 12 or more. Work is n log(n) squared for n words, and
    far less where few words recur.
    """
    codes = np.asarray(codes, np.uint64)
    n = len(codes)
    gaps = _gaps(codes)
    runs: dict[tuple[int, int], int] = {}
    found: list[tuple[int, int, int]] = []
    settled = np.zeros(n, np.int64)
    for width, low, high in _scales(min(n // 2, n - 1)):
        new = []
        known: dict[int, list[int]] = {}  # per period, the last stretch looked at
        for seeds in _seeds(codes, gaps, width, low, high, settled):
            for place, period in seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))].tolist():
                last = known.get(period)
                if last and last[0] <= place and place + width + period <= last[1]:
                    continue
                if not np.array_equal(codes[place : place + width], codes[place + period : place + period + width]):
                    continue
                start, end = _stretch(codes, place, period)
                known[period] = [start, end]
                if end - start >= max(least, 2 * period):
                    new.append((period, start, end))
        for period, start, end in sorted(new):
            # The same stretch has a smaller period if that one came first.
            if (start, end) not in runs:
                runs[start, end] = period
                found.append((start, end - start, period))
        # The next scale's blocks are as long as these periods.
        for start, length, period in found:
            if period <= 2 * width and (period > width or width == 2):
                settled[start : start + length] = np.maximum(settled[start : start + length], start + length)
    return sorted((s, length, p) for s, length, p in found)


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


# --- texts ---------------------------------------------------------------------------


def _together(texts: list[str | None], least: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """Words, runs and collapsed text of each text, from one search over all.

    Each text has numbers of its own, and one more after its last word, so that
    nothing recurs in another text.
    """
    cut = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # ASCII white space
    codes: list[int] = []
    starts, base = [], 0
    for words in cut:
        numbers: dict[bytes, int] = {}
        starts.append(len(codes))
        codes += [base + numbers.setdefault(w, len(numbers)) for w in words]
        base += len(numbers) + 1
        codes.append(base - 1)
    runs = find_runs(np.array(codes), least)
    own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (s, length, p), i in zip(runs, np.searchsorted(starts, [s for s, _, _ in runs], "right") - 1):
        own[i].append((s - starts[i], length, p))
    for words, mine in zip(cut, own):
        kept = words
        if mine:
            kept = [w for w, gone in zip(words, dropped(len(words), mine).tolist()) if not gone]
        yield len(words), mine, b" ".join(kept).decode("utf-8", "surrogatepass")


def _batched(texts: list[str | None]) -> Iterator[list[str | None]]:
    some, size = [], 0
    for t in texts:
        # A word takes two characters at least.
        if some and size + len(t or "") // 2 > _WORDS:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t or "") // 2 + 1
    if some:
        yield some


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs``.

    Words stand between ASCII white space. ``runs`` are the maximal runs as
    (start, length, period) by start, then period; ``collapsed`` holds, joined
    by one space, the words that no run contains after its first period. Null,
    empty and blank texts have no words, no runs and an empty collapsed text.
    Each row stands for itself: repeated rows give equal results, null ids
    stay, and other columns are not read. An empty table gives an empty
    result. Memory is bounded by one batch of rows, or one longer text.
    """

    @F.pandas_udf(f"n_words bigint, runs {RUNS}, collapsed string")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [x for some in _batched(texts.tolist()) for x in _together(some, least)]
            found = pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])
            found["runs"] = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found["runs"]]
            yield found

    return docs.select(F.col(doc_id).alias("doc_id"), search(F.col(text).cast("string")).alias("found")).select("doc_id", "found.*")
