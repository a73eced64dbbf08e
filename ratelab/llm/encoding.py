"""Token ids by the tokenizers library, with a bounded memory of pieces already encoded."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

_CHUNK = 1 << 21  # characters of a text encoded at once
_TOGETHER = 1 << 18  # characters of texts encoded in one call
_MEMO = 600_000  # pieces of a kind a worker remembers, about
_LINE = 256  # unknown words encoded as one text
_TAIL = ".,:;!?*%$#&|"  # punctuation after letters
_CUT = re.compile(r"(?<=\S) ")
_SPACE = "\u0120"  # how byte-level vocabularies write a space
_loaded: dict[str, "Encoder"] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters(word: str) -> bool:
    """Whether both kinds of vocabulary take ``word`` for one run of letters."""
    return word.isalpha() and (word.isascii() or word.lower().isalpha())


def _places(values: list, wanted: object) -> list[int]:
    """Where ``wanted`` stands in ``values``."""
    out, at = [], -1
    try:
        while True:
            at = values.index(wanted, at + 1)
            out.append(at)
    except ValueError:
        return out


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers.

    Both kinds of vocabulary file (byte-level and word-level BPE) first cut a
    text at known places and never join characters across them: before a space
    that follows a non-space, around a line feed between non-spaces, and
    between letters and the punctuation after them. A text cut there gives the
    same ids piece by piece. Pieces recur, so each is encoded by the library
    once and remembered. A piece that ends in white space, or is empty, is
    never remembered; its text is given to the library whole. Unknown words of
    letters go to the library as lines of words, and ids that only start or
    only end a word tell where each one's ids are; a line whose words cannot
    be told apart so is encoded word by word.
    """

    def __init__(self, path: str, memo: int = _MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._spaced: dict[str, bytes] = {}  # pieces after a space
        self._first: dict[str, bytes] = {}  # pieces at the start of a text
        self._tails: dict[str, bytes] = {"\n": self._plain(["\n"])[0]}
        self._memo = memo
        model, vocabulary = self._tokenizer.model, self._tokenizer.get_vocab()
        suffix, unknown = getattr(model, "end_of_word_suffix", None), getattr(model, "unk_token", None)
        self._by_end = bool(suffix)
        self._edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        edge = (lambda x: x.endswith(suffix)) if suffix else (lambda x: x.startswith(_SPACE))
        self._edge[[i for x, i in vocabulary.items() if edge(x)]] = True
        feed = np.frombuffer(self._tails["\n"], "<u4")
        self._feed = int(feed[0]) if len(feed) == 1 else -1
        self._unknown = vocabulary.get(unknown) if unknown else None

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _lines(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words of letters, each as if ``lead`` stood before it."""
        fed = not lead and not self._by_end  # a line feed takes the place of the space that would join the next word
        lines = [words[i : i + _LINE] for i in range(0, len(words), _LINE)]
        joined = [lead + ("\n" if fed else " ").join(x) for x in lines]
        out = []
        for line, x in zip(lines, self._tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(x.ids, "<u4")
            edges = np.flatnonzero(ids == self._feed if fed else self._edge[ids])
            if fed:
                starts, ends = [0, *(edges + 1)], [*edges, len(ids)]
            elif self._by_end:
                starts, ends = [0, *(edges[:-1] + 1)], edges + 1
            else:
                starts, ends = edges, [*edges[1:], len(ids)]
            # Each word has one edge at least: as many edges as words are one each.
            if len(starts) != len(line) or not len(ids) or starts[0] != 0 or ends[-1] != len(ids) or (ids == self._unknown).any():
                out += self._plain([lead + word for word in line])
                continue
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip(map(int, starts), map(int, ends))]
        return out

    def _words(self, known: dict[str, bytes], unknown: set[str], lead: str) -> None:
        """Remember unknown pieces; letters with punctuation after them as the two parts they are cut into."""
        new, plain, joined, also, tails = [], [], [], set(), set()
        for x in unknown:
            if _letters(x):
                plain.append(x)
                continue
            if x[-1:] not in _TAIL:
                if not x[-1].isspace():
                    new.append(x)
                continue
            word = x.rstrip(_TAIL)
            if not _letters(word):
                if x:
                    new.append(x)
                continue
            tail = x[len(word) :]
            joined.append((x, word, tail))
            if word not in known and word not in unknown:
                also.add(word)
            if tail not in self._tails:
                tails.add(tail)
        plain += also
        known.update(zip(plain, self._lines(plain, lead)))
        known.update(zip(new, self._plain([lead + x for x in new] if lead else new)))
        self._tails.update(zip(tails, self._plain(list(tails))))
        for x, word, tail in joined:
            known[x] = known[word] + self._tails[tail]

    def _learn(self, after: set[str], start: set[str]) -> list[str]:
        """Remember what is unknown. Gives the pieces over two lines, which are for this time only."""
        spaced, first = self._spaced, self._first
        lines = []
        for x in [x for x in after if "\n" in x]:
            head, _, rest = x.partition("\n")
            if head and not head[-1].isspace() and rest and not rest[0].isspace() and not rest[-1].isspace():
                lines.append((x, head, rest))
                after.remove(x)
        after.update([head for _, head, _ in lines if head not in spaced])
        start.update([rest for _, _, rest in lines if rest not in first])
        self._words(spaced, after, " ")
        self._words(first, start, "")
        feed = self._tails["\n"]
        for x, head, rest in lines:
            spaced[x] = spaced[head] + feed + first[rest]
        return [x for x, _, _ in lines]

    def _some(self, parts: list[tuple[str, bool]]) -> list[bytes]:
        """Ids of some texts; a flag says that the space a text was cut at stands before it."""
        for known in (self._spaced, self._first):
            if len(known) > self._memo:
                known.clear()
        if len(self._tails) > self._memo:
            self._tails = {"\n": self._tails["\n"]}
        cut = [text.split(" ") for text, _ in parts]
        first = [None if after else pieces.pop(0) for (_, after), pieces in zip(parts, cut)]
        spaced, start = self._spaced.get, self._first.get
        found = [list(map(spaced, pieces)) for pieces in cut]
        # Only the places without ids yet are looked up again.
        gaps = [_places(own, None) for own in found]
        new = {pieces[i] for pieces, own in zip(cut, gaps) for i in own}
        passing = self._learn(new, {x for x in first if x is not None and start(x) is None})
        out = []
        for (text, after), x, pieces, own, at in zip(parts, first, cut, found, gaps):
            for i in at:
                own[i] = spaced(pieces[i])
            head = b"" if x is None else start(x)
            if head is None or (at and None in own):
                out.append(self._plain([" " + text if after else text])[0])
            else:
                out.append(head + b"".join(own))
        for x in passing:
            del self._spaced[x]
        return out

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text; null is empty."""
        waiting: list[tuple[str, bool]] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > _CHUNK:
                yield from self._some(waiting)
                waiting, size = [], 0
                yield b"".join(self._some([(part, i > 0)])[0] for i, part in enumerate(self._chunks(text)))
                continue
            waiting.append((text, False))
            size += len(text)
            if size > _TOGETHER:
                yield from self._some(waiting)
                waiting, size = [], 0
        yield from self._some(waiting)

    def _chunks(self, text: str) -> Iterator[str]:
        at = 0
        while cut := _CUT.search(text, at + _CHUNK):
            yield text[at : cut.start()]
            at = cut.start() + 1  # the next one comes after that space
        yield text[at:]


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for ``path``."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
