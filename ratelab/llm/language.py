"""Language by unigram pieces, summed over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary,
learnt by expectation maximisation: a word's pieces are counted in all its
segmentations, each by its probability. The forward algorithm gives a word's
probability, the sum over all its segmentations; a text's is the product over
its words. The language under which the text is most probable is predicted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from ratelab.scratch import Scratch

PER_LANGUAGE = 2_000  # documents of a language to learn from, about; all if it has fewer
ROUNDS = 4  # of expectation maximisation
TASKS = 48  # a round's, whatever the size: its words are those of a bounded sample
SMOOTHING = 0.5  # added to each piece's expected count
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
MODEL_BYTES = 256 << 20  # a model is sent to every worker

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_SPACE = "▁"  # stands before a word's first letter in the vocabulary
_CHARS = 1 << 21  # characters cut into words at once
_CELLS = 1 << 20  # numbers of one step of the forward algorithm
_GRID = 1 << 15  # letters of words taken together
_HASHES = 1 << 30


class Vocabulary:
    """Pieces of lower-case letters, and bytes for letters that no piece holds."""

    def __init__(self, pieces: list[str]):
        """``pieces`` as the vocabulary file lists them."""
        whole = [p for p in pieces if p == _SPACE or (p == p.lower() and _LETTERS.fullmatch(p.removeprefix(_SPACE)))]
        self.index = {p: i for i, p in enumerate(dict.fromkeys(whole))}
        self.letters = len(self.index)
        self.size = self.letters + 256
        self.longest = max(map(len, self.index), default=1)
        # A tree of letters: sorted (node, letter) keys, the nodes they lead to, and the piece that ends at a node.
        ways: dict[int, int] = {}
        ends = [-1]
        for piece, number in self.index.items():
            node = 0
            for letter in piece:
                node = ways.setdefault(node << 21 | ord(letter), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = number
        self.keys = np.array(sorted(ways), np.int64)
        self.next = np.array([ways[k] for k in sorted(ways)], np.int64)
        self.ends = np.array(ends)

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return cls([model.id_to_piece(i) for i in range(model.get_piece_size())])


class Segmenter:
    """Sums over all segmentations of words, for log probabilities (pieces x languages)."""

    def __init__(self, vocabulary: Vocabulary, logs: np.ndarray):
        self.vocabulary = vocabulary
        # Letters outside the vocabulary are products of bytes, and get rows of their own.
        self.numbers: dict[str, int] = {}
        self.spelt: dict[int, list[int]] = {}
        self.logs = logs

    def _grid(self, words: list[str]) -> np.ndarray:
        """Piece numbers by word, end and length less one; -1 where there is no such piece."""
        own, most = self.vocabulary, self.vocabulary.longest
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), int(sizes.max()), most), -1, np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(words)), sizes)
        column = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = sizes[row] - column
        # All places walk down the tree together, until no piece goes on.
        at, node, top = np.arange(len(letters)), np.zeros(len(letters), np.int64), 1
        for length in range(1, most + 1):
            inside = left[at] >= length
            at, node = at[inside], node[inside]
            key = node << 21 | letters[at + length - 1]
            way = np.minimum(np.searchsorted(own.keys, key), len(own.keys) - 1)
            found = own.keys[way] == key
            at, node = at[found], own.next[way[found]]
            if not len(at):
                break
            top = length
            piece = own.ends[node]
            whole = at[piece >= 0]
            ids[row[whole], column[whole] + length - 1, length - 1] = piece[piece >= 0]
        lone = ids[row, column, 0] < 0
        if lone.any():
            kinds, which = np.unique(letters[lone], return_inverse=True)
            numbers = np.array([self._spell(chr(k)) for k in kinds.tolist()])
            ids[row[lone], column[lone], 0] = numbers[which]
        return ids[:, :, :top]

    def _spell(self, letter: str) -> int:
        if letter in self.numbers:
            return self.numbers[letter]
        number = self.vocabulary.size + len(self.spelt)
        own = [self.vocabulary.letters + b for b in letter.encode("utf-8", "surrogatepass")]
        self.numbers[letter], self.spelt[number] = number, own
        self.logs = np.vstack([self.logs, self.logs[own].sum(axis=0)])
        return number

    def _chunks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words of like length, and their grid."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        at, most = 0, self.vocabulary.longest * self.logs.shape[1]
        while at < len(order):
            some = max(1, min(_GRID // max(int(sizes[order[at]]), 1), _CELLS // most))
            # No word is more than twice as long as another one beside it.
            chunk = order[at : at + some]
            chunk = chunk[sizes[chunk] <= 2 * sizes[chunk[0]] + 8]
            at += len(chunk)
            yield chunk, self._grid([words[i] for i in chunk.tolist()])

    def _forward(self, ids: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Log sums over the segmentations of each word's first letters, by their number."""
        count, size, most = ids.shape
        out = np.full((count, size + 1, logs.shape[1]), -np.inf)
        out[:, 0] = 0.0
        for end in range(1, size + 1):
            k = min(most, end)
            # The last row of the logs is minus infinity: no such piece.
            out[:, end] = _log_sum(out[:, end - k : end][:, ::-1] + logs[ids[:, end - 1, :k]])
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word under each language."""
        out = np.zeros((len(words), self.logs.shape[1]))
        for chunk, ids in self._chunks(words):
            sums = self._forward(ids, self._table())
            out[chunk] = sums[np.arange(len(chunk)), [len(words[i]) for i in chunk.tolist()]]
        return out

    def _table(self) -> np.ndarray:
        return np.vstack([self.logs, np.full((1, self.logs.shape[1]), -np.inf)])

    def expect(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece in all segmentations of the words; one language only."""
        out = np.zeros(self.vocabulary.size)
        for chunk, ids in self._chunks(words):
            logs = self._table()
            ahead = self._forward(ids, logs)[:, :, 0]
            size, most = ids.shape[1:]
            ends = np.array([len(words[i]) for i in chunk.tolist()])
            rows = np.arange(len(chunk))
            after = np.full((len(chunk), size + 1), -np.inf)
            after[rows, ends] = 0.0
            for start in range(size - 1, -1, -1):
                k = min(most, size - start)
                lengths = np.arange(k)
                own = logs[ids[:, start + lengths, lengths], 0] + after[:, start + 1 : start + k + 1]
                after[:, start] = np.where(ends == start, after[:, start], _log_sum(own[:, :, None])[:, 0])
            total = ahead[rows, ends]
            for end in range(1, size + 1):
                k = min(most, end)
                at = ids[:, end - 1, :k]
                weight = ahead[:, end - k : end][:, ::-1] + logs[at, 0] + (after[:, end] - total)[:, None]
                seen = at >= 0
                number, share = at[seen], (np.exp(weight) * counts[chunk][:, None])[seen]
                known = number < self.vocabulary.size
                out += np.bincount(number[known], share[known], self.vocabulary.size)
                for n, s in zip(number[~known].tolist(), share[~known].tolist()):
                    for byte in self.spelt[n]:
                        out[byte] += s
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over the second axis."""
    most = x.max(axis=1)
    least = np.where(np.isfinite(most), most, 0.0)
    with np.errstate(divide="ignore"):
        return least + np.log(np.exp(x - least[:, None]).sum(axis=1))


# --- words -----------------------------------------------------------------------------


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about _CHARS characters, cut where no word is."""
    at = 0
    while len(text) - at > _CHARS:
        end = at + _CHARS
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def words_of(texts: Iterable[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(place of the text, words of it), with the mark of a word's start; long texts in parts."""
    for i, text in enumerate(texts):
        for part in _slices((text or "").lower()):
            yield i, [_SPACE + w for w in _LETTERS.findall(part)]


def totals(texts: list[str | None], segmenter: Segmenter) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text under each language, and the number of its words."""
    sums = np.zeros((len(texts), segmenter.logs.shape[1]))
    number = np.zeros(len(texts), np.int64)
    owners: list[int] = []
    words: list[str] = []

    def add() -> None:
        codes, known = pd.factorize(np.array(words, object))
        scores = segmenter.score(known.tolist())
        np.add.at(sums, owners, scores[codes])
        np.add.at(number, owners, 1)
        owners.clear()
        words.clear()

    for i, some in words_of(texts):
        words += some
        owners += [i] * len(some)
        if len(words) > _CHARS // 4:
            add()
    if words:
        add()
    return sums, number


# --- learning --------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    languages: list[str]
    logs: np.ndarray


def held_out(doc_id: str) -> Column:
    """Whether a row is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, own in batch.groupby("lang", sort=False):
            seen: Counter[str] = Counter()
            for _, some in words_of(own["text"]):
                seen.update(some)
                if len(seen) > _CHARS // 4:
                    yield pd.DataFrame({"lang": lang, "word": list(seen), "n": list(seen.values())})
                    seen.clear()
            yield pd.DataFrame({"lang": lang, "word": list(seen), "n": list(seen.values())})


def learn(
    docs: DataFrame, vocabulary: Vocabulary, scratch: Scratch, doc_id: str = "doc_id", text: str = "text",
    lang: str = "lang", per_language: int = PER_LANGUAGE, rounds: int = ROUNDS,
) -> Model:
    """Piece distributions of all languages of ``docs``, from rows that are not held out.

    About ``per_language`` rows of each language are taken by a hash of their
    id, all of them if there are fewer. Words are counted over the cluster, and
    each round is one job over distinct words. Rows without id, text or
    language teach nothing.
    """
    rows = docs.select(
        F.col(doc_id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"),
        F.col(text).cast("string").alias("text"), held_out(doc_id).alias("out"),
    ).filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL AND NOT out")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if 8 * len(languages) * vocabulary.size > MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages make a model too large to send to every worker")
    if not languages:
        return Model(vocabulary, [], np.zeros((vocabulary.size, 0)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    taken = rows.filter(F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(_HASHES)) < share[F.col("lang")] * _HASHES)
    counted = taken.select("lang", "text").mapInPandas(_counted, "lang string, word string, n long")
    words = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(TASKS, "lang", "word")
    words = scratch.keep(words, "language_words")
    place = {k: i for i, k in enumerate(languages)}
    logs = np.full((vocabulary.size, len(languages)), -math.log(vocabulary.size))

    def expected(logs: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, own in batch.groupby("lang", sort=False):
                    segmenter = Segmenter(vocabulary, logs[:, [place[name]]])
                    counts = segmenter.expect(own["word"].tolist(), own["n"].to_numpy(float))
                    at = np.flatnonzero(counts)
                    yield pd.DataFrame({"lang": name, "piece": at, "n": counts[at]})

        return run

    for _ in range(rounds):
        found = words.mapInPandas(expected(logs), "lang string, piece long, n double")
        # At most pieces x languages rows, a size checked above.
        found = found.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full(logs.shape, SMOOTHING)
        counts[found["piece"].to_numpy(), found["lang"].map(place).to_numpy(int)] += found["n"].to_numpy()
        logs = np.log(counts / counts.sum(axis=0))
    return Model(vocabulary, languages, logs)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``; see ``identify``."""
    languages = np.array([*model.languages, UNDETERMINED], object)

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        segmenter = Segmenter(model.vocabulary, model.logs)
        for texts in batches:
            best, score = np.full(len(texts), len(languages) - 1), np.zeros(len(texts))
            if model.languages:
                sums, words = totals(texts.tolist(), segmenter)
                some = words > 0
                best[some] = sums[some].argmax(axis=1)
                apart = sums[some] - sums[some].max(axis=1, keepdims=True)
                score[some] = 1.0 / np.exp(apart).sum(axis=1)
            yield pd.DataFrame({"lang_pred": languages[best], "score": score})

    return docs.select(F.col(doc_id).alias("doc_id"), of(F.col(text).cast("string")).alias("found")).select("doc_id", "found.*")


def identify(
    docs: DataFrame, vocabulary: Vocabulary, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    lang_pred is the language under which the whole text is most probable, and
    score its probability among the languages learnt, all equally likely
    beforehand; a tie goes to the first language in sort order. Text that is
    null or has no letter is ``und`` with score 0, and so is every text if
    there is nothing to learn from. Languages, sources and ids are no inputs of
    a prediction. Long texts are cut into words part by part; repeated rows are
    predicted alike; an empty table gives an empty result. Other columns are
    not read.
    """
    model = learn(docs, vocabulary, scratch, doc_id, text, lang)
    found = predict(docs.select(F.struct(F.col(doc_id).alias("id"), held_out(doc_id).alias("out")).alias("doc_id"), F.col(text).alias("text")), model)
    return found.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.out").alias("held_out"), "lang_pred", "score")
