"""SentencePiece encoding of giant texts by a max-plus parallel scan, and decoding.

The best segmentation of a text maximises the sum of its pieces' scores. A
text is cut into chunks; a state says how far the last piece reaches over a
chunk's end. A chunk's transfer matrix holds the best sum from each state to
each state; matrices combine associatively, in a tree, so no task sees more
than FAN of them. Once the states at all chunk ends are known, each chunk is
traced back by itself.

Scores are whole numbers (those under FLOOR count as FLOOR), so sums are exact
and combining in any order gives the same result. Of segmentations with equal
sums the one with the longest last piece is taken, then of the text before it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ratelab.scratch import Scratch

CHUNK = 1 << 15  # characters; longer texts are cut
FAN = 64  # matrices combined in one group
FLOOR = -1_000_000.0
UNKNOWN = -10.0  # below the lowest score
_MEMO = 500_000
_TOGETHER = 1 << 18  # characters of texts whose new units are learnt in one go
_LETTER = 1 << 31  # marks a code point among ids
_SHORT = 48  # characters of a unit that is learnt with others
_SPACE = "▁"
_UNIT = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
_NEVER = float("-inf")
_loaded: dict[str, "Pieces"] = {}


class Pieces:
    """The pieces of a model file, with their scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: max(model.get_score(i), FLOOR) for i in plain}
        self.unknown = min(self.score.values()) + UNKNOWN
        # Scores of pieces, and None for what only begins some piece: a search ends where neither goes on.
        self.begun: dict[str, float | None] = dict.fromkeys(p[:i] for p in self.id for i in range(1, len(p)))
        self.begun.update(self.score)
        self.byte = {int(t[1:-1], 16): i for i, t in enumerate(self.text) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unk_id = model.unk_id()
        self.longest = max(map(len, self.id))
        # No piece goes on after a space that follows other characters: every text can be cut there.
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in self.id)
        self.spelt = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.text)]
        self._ids: dict[str, bytes] = {}
        self._sum: dict[str, float] = {}
        self._trie()

    def ids(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.byte.get(b, self.unk_id) for b in piece.encode("utf-8", "surrogatepass")]

    def forward(self, s: str, n: int, entry: list[float]) -> tuple[list[float], list[int]]:
        """Best sums to positions of ``s`` by pieces that start before ``n``, and where the last piece starts (-1: entered there)."""
        best = entry[: len(s) + 1] + [_NEVER] * (len(s) + 1 - len(entry))
        back = [-1] * len(best)
        begun, unknown, end = self.begun, self.unknown, len(s)
        for b in range(min(n, end)):
            at = best[b]
            if at == _NEVER:
                continue
            e = b + 1
            w = begun.get(s[b:e])
            total = at + (unknown if w is None else w)
            if total > best[e]:
                best[e], back[e] = total, b
            while e < end:
                e += 1
                w = begun.get(s[b:e], 0.0)
                if w is None:
                    continue
                if w == 0.0 and s[b:e] not in begun:
                    break
                if at + w > best[e]:
                    best[e], back[e] = at + w, b
        return best, back

    def trace(self, s: str, back: list[int], end: int) -> tuple[int, bytes]:
        """Where the best path to ``end`` enters, and its ids."""
        found: list[str] = []
        while back[end] >= 0:
            found.append(s[back[end] : end])
            end = back[end]
        return end, array("I", [i for p in reversed(found) for i in self.ids(p)]).tobytes()

    def unit(self, s: str) -> tuple[float, bytes]:
        """Best sum and ids of a text without an inner cut; remembered."""
        if s not in self._ids:
            best, back = self.forward(s, len(s), [0.0])
            self._sum[s], self._ids[s] = best[-1], self.trace(s, back, len(s))[1]
        return self._sum[s], self._ids[s]

    def _forget(self) -> None:
        if len(self._ids) > _MEMO:
            self._ids.clear()
            self._sum.clear()

    def _trie(self) -> None:
        """``begun`` as arrays: a node per beginning of a piece, its children by (node, letter)."""
        nodes = ["", *self.begun]
        number = {x: i for i, x in enumerate(nodes)}
        letters = sorted({c for p in self.id for c in p})
        self.letter = np.zeros(0x110000, np.int64)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.wide = len(letters) + 1
        steps = np.array([number[x[:-1]] * self.wide + self.letter[ord(x[-1])] for x in nodes[1:]])
        order = np.argsort(steps)
        self.steps, self.child = steps[order], order + 1
        self.node_score = np.array([_NEVER if self.begun.get(x) is None else self.begun[x] for x in nodes])
        self.node_id = np.array([self.id.get(x, -1) for x in nodes], np.int64)

    def learn(self, units: list[str]) -> None:
        """Remember ``unit`` of many short distinct texts: ``forward`` and ``trace`` on all of them side by side."""
        units = sorted(units, key=len, reverse=True)
        size = np.array([len(u) for u in units])
        n, most = len(units), int(size[0])
        letters = np.array(units, f"<U{most}").view(np.uint32).reshape(n, most)
        text = self.letter[letters]
        best = np.full((n, most + 1), _NEVER)
        best[:, 0] = 0.0
        back, last = np.zeros((n, most + 1), np.int64), np.full((n, most + 1), -1, np.int64)
        for b in range(most):
            row = np.arange(np.searchsorted(-size, -b))  # those longer than b
            at, node = best[: len(row), b], np.zeros(len(row), np.int64)
            lone = np.ones(len(row), bool)
            for e in range(b + 1, min(b + self.longest, most) + 1):
                inside = np.searchsorted(row, np.searchsorted(-size, -(e - 1)))
                row, node = row[:inside], node[:inside]
                key = node * self.wide + text[row, e - 1]
                place = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
                on = np.flatnonzero(self.steps[place] == key)
                row, node = row[on], self.child[place[on]]
                if not len(row):
                    break
                w = self.node_score[node]
                if e == b + 1:
                    lone[row[w > _NEVER]] = False
                total = at[row] + w
                up = np.flatnonzero(total > best[row, e])
                own = row[up]
                best[own, e], back[own, e], last[own, e] = total[up], b, self.node_id[node[up]]
            own = np.flatnonzero(lone)  # their next letter is no piece
            total = at[own] + self.unknown
            up = np.flatnonzero(total > best[own, b + 1])
            best[own[up], b + 1], back[own[up], b + 1], last[own[up], b + 1] = total[up], b, -1
        ids, free = np.zeros((n, most), "<u4"), np.full(n, most)
        row, end, plain = np.arange(n), size.copy(), np.ones(n, bool)
        while len(row):
            found = last[row, end[row]]
            plain[row[found < 0]] = False
            free[row] -= 1
            ids[row, free[row]] = np.where(found < 0, _LETTER + letters[row, end[row] - 1], found)
            end[row] = back[row, end[row]]
            row = row[end[row] > 0]
        self._sum.update(zip(units, best[np.arange(n), size].tolist()))
        for u, own, at, ok in zip(units, ids, free.tolist(), plain.tolist()):
            found = own[at:]
            if not ok:  # characters that are no piece become bytes
                found = np.array([j for i in found.tolist() for j in ([i] if i < _LETTER else self.ids(chr(i - _LETTER)))], "<u4")
            self._ids[u] = found.tobytes()

    def whole_all(self, texts: Iterable[str]) -> Iterator[tuple[bytes, bool]]:
        """``whole`` of each text, the new units of some texts learnt together."""
        waiting: list[tuple[str, list[str]]] = []
        size = 0
        for s in chain(texts, [None]):
            if s is not None:
                waiting.append((s, self.units(s)))
                size += len(s)
            if s is None or size > _TOGETHER:
                self._forget()
                new = set(chain.from_iterable(units for _, units in waiting)).difference(self._ids)
                short = [u for u in new if len(u) <= _SHORT]
                if short:
                    self.learn(short)
                for u in new.difference(short):
                    self.unit(u)
                for own, units in waiting:
                    yield self.whole(own, units)
                waiting, size = [], 0

    def units(self, s: str) -> list[str]:
        return _UNIT.findall(s) if self.cuts else [s]

    def whole(self, s: str, units: list[str]) -> tuple[bytes, bool]:
        """Ids of a text whose units are remembered, and whether they decode to it."""
        ids = b"".join(map(self._ids.__getitem__, units))
        return ids, self.decode(np.frombuffer(ids, "<u4").tolist()) == s

    def parts(self, s: str, n: int) -> tuple[int, list[str], int] | None:
        """First cut, units up to the last cut, last cut among positions 0 < p <= n; None without cuts."""
        if not self.cuts:
            return None
        ends = [m.end() for m in _UNIT.finditer(s)]
        cuts = [e for e in ends if e <= n and e < len(s) and s[e] == _SPACE]
        if not cuts:
            return None
        return cuts[0], _UNIT.findall(s[cuts[0] : cuts[-1]]), cuts[-1]

    def transfer(self, s: str, n: int) -> np.ndarray:
        """Best sums from each state at a chunk's start to each state at its end; ``s`` reaches beyond ``n``."""
        self._forget()
        m = np.full((self.longest, self.longest), _NEVER)
        cut = self.parts(s, n)
        for i in range(min(self.longest, n + 1)):
            entry = [_NEVER] * i + [0.0]
            if cut:
                if i <= cut[0]:
                    m[i, 0] = self.forward(s[: cut[0]], cut[0], entry)[0][cut[0]]
            else:
                row = self.forward(s, n, entry)[0][n : n + self.longest]
                m[i, : len(row)] = row
        for i in range(n + 1, min(self.longest, len(s) + 1)):
            m[i, i - n] = 0.0  # the piece before reaches over the whole chunk
        if cut:
            last = self.forward(s[cut[2] :], n - cut[2], [0.0])[0][n - cut[2] :][: self.longest]
            tail = np.full(self.longest, _NEVER)
            tail[: len(last)] = last
            middle = sum(self.unit(u)[0] for u in cut[1])
            m[: n + 1] = m[: n + 1, :1] + (middle + tail)
        return m

    def entries(self, s: str, n: int, values: list[float]) -> np.ndarray:
        """For each state at the end, 0 at the state at the start that its best path comes from."""
        out = np.full((self.longest, self.longest), _NEVER)
        values = values[: n + 1]
        cut = self.parts(s, n)
        upto, limit = (s[: cut[0]], cut[0]) if cut else (s, n)
        best, back = self.forward(upto, limit, list(values))
        for j in range(self.longest):
            at = cut[0] if cut else n + j
            if at < len(best) and best[at] > _NEVER:
                out[j, self.trace(upto, back, at)[0]] = 0.0
        return out

    def between(self, s: str, n: int, start: int, end: int) -> bytes:
        """Ids of the best path from state ``start`` to state ``end``."""
        if start > n:
            return b""
        self._forget()
        entry = [_NEVER] * start + [0.0]
        cut = self.parts(s, n)
        if not cut or start > cut[0]:
            return self.trace(s, self.forward(s, n, entry)[1], n + end)[1]
        head = self.trace(s, self.forward(s[: cut[0]], cut[0], entry)[1], cut[0])[1]
        rest = s[cut[2] :]
        tail = self.trace(rest, self.forward(rest, n - cut[2], [0.0])[1], n - cut[2] + end)[1]
        return b"".join([head, *[self.unit(u)[1] for u in cut[1]], tail])

    def decode(self, ids: list[int]) -> str:
        """Text of ids with its spaces still as the marker; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")


def pieces(path: str) -> Pieces:
    """The pieces of this worker process for ``path``."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def marked(text: str) -> str:
    """The text as pieces spell it: a marker in front and for each space."""
    return _SPACE + text.replace(" ", _SPACE) if text else ""


def plain(spelt: str) -> str:
    return spelt.replace(_SPACE, " ")[1:]


def _product(group: list[np.ndarray]) -> np.ndarray:
    out = group[0]
    for m in group[1:]:
        out = (out[:, :, None] + m[None]).max(axis=1)
    return out


def state_vectors(matrices: DataFrame, last: int, size: int, scratch: Scratch, name: str) -> DataFrame:
    """``row, k, v``: best sums to the states before matrix ``k`` of a row, from state 0 before its first.

    ``matrices`` (``row, k, m``) is stored and ``last`` its largest ``k``.
    Up the tree FAN neighbours become their product, down it each group gets
    the vector before it and passes on those before its members.
    """
    def up(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("k")
        m = _product([np.array(x).reshape(size, size) for x in own["m"]])
        return pd.DataFrame({"row": [own["row"].iloc[0]], "k": [own["k"].iloc[0] // FAN], "m": [m.ravel()]})

    def down(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("k")
        v, out = np.array(own["before"].iloc[0], float), []
        for x in own["m"]:
            out.append(v)
            v = (v[:, None] + np.array(x).reshape(size, size)).max(axis=0)
        return pd.DataFrame({"row": own["row"], "k": own["k"], "v": out})

    levels = [matrices]
    while last >= FAN:
        last //= FAN
        above = levels[-1].groupBy("row", F.floor(F.col("k") / FAN)).applyInPandas(up, "row long, k long, m array<double>")
        levels.append(scratch.keep(above, f"{name}_up{len(levels)}"))
    start = F.lit([0.0] + [_NEVER] * (size - 1))
    vectors = levels[-1].select("row", F.lit(0).cast("long").alias("k"), start.alias("before")).distinct()
    for height in reversed(range(len(levels))):
        level, group = levels[height], F.floor(F.col("k") / FAN)
        joined = level.withColumn("g", group).join(vectors.withColumnRenamed("k", "g").hint("merge"), ["row", "g"])
        found = joined.groupBy("row", "g").applyInPandas(down, "row long, k long, v array<double>")
        vectors = scratch.keep(found, f"{name}_down{height}").withColumnRenamed("v", "before")
    return vectors.select("row", "k", F.col("before").alias("v"))


def _is_long(text: Column, chunk: int) -> Column:
    return F.length(text) >= chunk


def _cut(text: Column, chunk: int) -> Column:
    """The spelt text in chunks, as an array."""
    spelt = F.when(text == "", "").otherwise(F.concat(F.lit(_SPACE), F.translate(text, " ", _SPACE)))
    return F.regexp_extract_all(spelt, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))


def encode_texts(docs: DataFrame, scratch: Scratch, model: str, row: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """``row, k, ids (binary, 32-bit little-endian), spelt_right`` for every chunk of every row of ``docs``.

    ``row`` must be the same whenever ``docs`` is read.
    """
    texts = docs.select(F.col(row).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    @F.pandas_udf("struct<ids: binary, spelt_right: boolean>")
    def whole(texts: pd.Series) -> pd.DataFrame:
        own = pieces(model)
        found = list(own.whole_all(map(marked, texts)))
        # The marker in a text comes back as a space.
        right = [ok and _SPACE not in t for (_, ok), t in zip(found, texts)]
        return pd.DataFrame({"ids": [x[0] for x in found], "spelt_right": right})

    is_long = _is_long(F.col("text"), chunk)
    short = texts.filter(~is_long).select("row", F.lit(0).cast("long").alias("k"), whole("text").alias("x")).select("row", "k", "x.*")
    return short.unionByName(encode_chunks(texts.filter(is_long).select("row", _cut(F.col("text"), chunk).alias("c")), scratch, model, chunk))


def encode_chunks(cut: DataFrame, scratch: Scratch, model: str, chunk: int) -> DataFrame:
    """The same for long texts that are already cut: ``row, c`` (array of chunks)."""
    reach = pieces(model).longest
    if chunk < reach:
        raise ValueError(f"a chunk must hold the longest piece, {reach} characters")
    # Chunks come with the characters that a piece may reach into.
    ahead = F.coalesce(F.get("c", F.col("i") + 1), F.lit(""))
    each = cut.select("row", "c", F.posexplode("c").alias("i", "own"))
    chunks = each.select(
        "row", F.col("i").cast("long").alias("k"), F.length("own").alias("n"), (F.size("c") - 1 - F.col("i")).cast("long").alias("left"),
        F.concat("own", F.substring(ahead, 1, reach - 1)).alias("s"),
    )
    chunks = scratch.keep(chunks, "chunks")
    most = chunks.agg(F.max("k")).first()[0]
    if most is None:
        return chunks.select("row", "k", F.lit(None).cast("binary").alias("ids"), F.lit(True).alias("spelt_right"))

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces(model)
        for b in batches:
            yield pd.DataFrame({"row": b["row"], "k": b["k"], "m": [own.transfer(s, n).ravel() for s, n in zip(b["s"], b["n"])]})

    forward = scratch.keep(chunks.select("row", "k", "s", "n").mapInPandas(transfers, "row long, k long, m array<double>"), "transfers")
    values = state_vectors(forward, most, reach, scratch, "forward")

    def origins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces(model)
        for b in batches:
            made = [own.entries(s, n, list(v)).ravel() for s, n, v in zip(b["s"], b["n"], b["v"])]
            yield pd.DataFrame({"row": b["row"], "k": b["left"], "m": made})

    # Back from the end, where no piece reaches over: the same scan on the chunks in falling order.
    backward = chunks.join(values.hint("merge"), ["row", "k"]).select("row", "left", "s", "n", "v").mapInPandas(origins, "row long, k long, m array<double>")
    ends = state_vectors(scratch.keep(backward, "origins"), most, reach, scratch, "backward")
    state = F.array_position("v", F.lit(0.0)) - 1  # one state is left
    ends = ends.select("row", F.col("k").alias("left"), state.alias("end"))
    starts = ends.select("row", (F.col("left") - 1).alias("left"), F.col("end").alias("start"))

    def traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pieces(model)
        for b in batches:
            ids, right = [], []
            for s, n, i, j in zip(b["s"], b["n"], b["start"], b["end"]):
                ids.append(own.between(s, n, int(i), int(j)))
                right.append(own.decode(np.frombuffer(ids[-1], "<u4").tolist()) == s[int(i) : n + int(j)])
            yield pd.DataFrame({"row": b["row"], "k": b["k"], "ids": ids, "spelt_right": right})

    known = chunks.join(ends.hint("merge"), ["row", "left"]).join(starts.hint("merge"), ["row", "left"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    return known.select("row", "k", "s", "n", "start", "end").mapInPandas(traces, "row long, k long, ids binary, spelt_right boolean")


def encode_documents(docs: DataFrame, scratch: Scratch, model: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, n_chunks, round_trip`` of every row of ``docs``.

    ``ids_crc32`` is that of all ids as little-endian unsigned 32-bit integers;
    ``round_trip`` says that decoding gives the text back (it does unless the
    text holds the space marker itself). Null text is empty and has no ids.
    Repeated rows are encoded each; an empty table gives an empty result. Only
    ids and texts are read.
    """
    own_row = F.monotonically_increasing_id().alias("row")
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(""))

    @F.pandas_udf("struct<n_tokens: long, ids_crc32: long, round_trip: boolean>")
    def whole(texts: pd.Series) -> pd.DataFrame:
        own, out = pieces(model), []
        # Long texts come as null: they are chunks elsewhere.
        for t, (ids, ok) in zip(texts, own.whole_all("" if t is None else marked(t) for t in texts)):
            out.append((len(ids) // 4, zlib.crc32(ids), t is None or ok and _SPACE not in t))
        return pd.DataFrame(out, columns=["n_tokens", "ids_crc32", "round_trip"])

    # One pass: short texts leave their digest, long ones their chunks.
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of.alias("text")).select(own_row, "doc_id", "text")
    is_long = _is_long(F.col("text"), chunk)
    rows = rows.select(
        "row", "doc_id", whole(F.when(~is_long, F.col("text"))).alias("d"), F.when(is_long, _cut(F.col("text"), chunk)).alias("c"),
        F.contains("text", F.lit(_SPACE)).alias("marker"),
    )
    rows = scratch.keep(rows, "rows")
    short = rows.filter("c IS NULL").select("doc_id", "d.n_tokens", "d.ids_crc32", F.lit(1).cast("long").alias("n_chunks"), "d.round_trip")
    found = encode_chunks(rows.filter("c IS NOT NULL").select("row", "c"), scratch, model, chunk)
    # Chunks of one document come together here: bounded by the document.
    joined = found.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.min("spelt_right").alias("round_trip"), F.count(F.lit(1)).alias("n_chunks")
    )

    @F.pandas_udf("struct<n_tokens: long, ids_crc32: long>")
    def digest(parts: pd.Series) -> pd.DataFrame:
        n, crcs = [], []
        for own in parts:
            crc = 0
            for x in own:
                crc = zlib.crc32(x["ids"], crc)
            n.append(sum(len(x["ids"]) for x in own) // 4)
            crcs.append(crc)
        return pd.DataFrame({"n_tokens": n, "ids_crc32": crcs})

    long = rows.filter("c IS NOT NULL").select("row", "doc_id", "marker").join(joined.hint("merge"), "row")
    long = long.select("doc_id", digest("parts").alias("d"), "n_chunks", (F.col("round_trip") & ~F.col("marker")).alias("round_trip"))
    return short.unionByName(long.select("doc_id", "d.n_tokens", "d.ids_crc32", "n_chunks", "round_trip"))


def decode_ids(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``text``: the inverse, from an array of ids per row; null ids give null."""

    @F.pandas_udf("string")
    def decoded(rows: pd.Series) -> pd.Series:
        own = pieces(model)
        return pd.Series([None if x is None else plain(own.decode(list(x))) for x in rows], dtype=object)

    return encoded.withColumn("text", decoded(F.col(ids)))
