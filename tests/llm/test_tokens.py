import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ratelab.llm import encoding, packing, records
from ratelab.llm.encoding import Encoder, vocabulary
from ratelab.llm.packing import pack, plan_bins, reduce_by_dominance, sequences, slots
from ratelab.llm.records import index_records, positions, read_shuffled, records as parse, token_records, write_records

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, row string, piece string, start string"
ENCODERS = {p: Encoder(p, memo=50) for p in (BYTES, WORDS)}


def whole(path, text):
    return np.array(ENCODERS[path]._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t  \x1c\x85'sabEİé́😀1.,*|<|>"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_pieces_give_the_ids_of_the_whole(path, text):
    assert ENCODERS[path].encode(text) == whole(path, text)
    assert ENCODERS[path].encode(text) == whole(path, text)  # now from memory


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_special_strings_and_chunks(path, monkeypatch):
    monkeypatch.setattr(encoding, "_CHUNK", 5)
    rng = random.Random(1)
    for text in ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|> y", *("".join(rng.choice("ab  \n.é'") for _ in range(80)) for _ in range(60))]:
        assert ENCODERS[path].encode(text) == whole(path, text)


def docs(spark, extra=()):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "Word", "of", "naïve\n", "x" * 9]) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    rows += [(100, "long one " * 3000), (None, "no id"), (7, None), (7, "again"), *extra]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, "r", "p", "s") for r in rows], SCHEMA)


def order(rows):
    return sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))


def test_records(spark, scratch):
    rows, frame = docs(spark, [(200, "y" * 70_000)])
    path = scratch.table("records")
    write_records(frame, path, BYTES, file_text=2000)
    index = index_records(spark, path)
    got = sorted(positions(index).collect(), key=lambda r: r.start)
    assert len({r.file for r in got}) > 5
    expect, at = [], 0
    for i in order(rows):
        ids = whole(BYTES, rows[i][1] or "") + bytes(4)
        expect.append((rows[i][0], len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    group = lambda xs: [sorted(map(repr, g)) for _, g in itertools.groupby(xs, key=lambda x: x[0])]  # noqa: E731  repeated ids in any order
    assert group([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got]) == group(expect)
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    shuffled = read_shuffled(spark, path, 1).collect()
    assert sorted(zlib.crc32(np.array(r.ids, "<u4")) for r in shuffled) == sorted(x[2] for x in expect)
    assert [r.ids for r in shuffled] == [r.ids for r in read_shuffled(spark, path, 1).collect()]
    assert [r.ids for r in shuffled] != [r.ids for r in read_shuffled(spark, path, 2).collect()]


def test_damage_is_found():
    good = records.frame(5, np.array([1, 2, 70_000])) + b"\n" + records.frame(None, np.array([3])) + b"\n"
    assert [(d, i.tolist()) for _, _, d, i in parse(good)] == [(5, [1, 2, 70_000]), (None, [3])]
    for at in (0, 9, 13, 20, 30, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(Exception):
            list(parse(bytes(bad)))


def test_records_of_an_empty_table(spark, scratch):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_records(empty, scratch.table("none"), BYTES).count() == 0


counts = st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 6), max_size=9)))


@settings(max_examples=300, deadline=None)
@given(counts)
def test_plans_hold_everything_once(given_):
    capacity, instance = given_
    found = {}
    for pattern, bins in plan_bins(dict(instance), capacity):
        assert bins > 0 and sum(w * k for w, k in pattern) <= capacity
        for w, k in pattern:
            found[w] = found.get(w, 0) + k * bins
    assert found == instance


def fewest(items, capacity):
    """Brute force: the least number of bins."""
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            place(i + 1, rooms[:j] + [rooms[j] - items[i]] + rooms[j + 1 :])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(5, 20).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_reduction_keeps_an_optimum(given_):
    capacity, items = given_
    items = sorted(items, reverse=True)
    fixed, rest = reduce_by_dominance({w: items.count(w) for w in items}, capacity)
    left = sorted((w for w, n in rest.items() for _ in range(n)), reverse=True)
    assert sum(b for _, b in fixed) + fewest(left, capacity) == fewest(items, capacity)


def test_packing(spark, scratch):
    rows, frame = docs(spark)
    capacity = 64
    got = pack(frame, scratch, WORDS, capacity=capacity).collect()
    want = []
    for i, t in rows:
        ids = whole(WORDS, t or "") + (1).to_bytes(4, "little")
        for p, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            want.append((i, p, at // 4, len(part) // 4, zlib.crc32(part)))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == sorted(want, key=repr)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
        assert sum(n for _, n in own) <= capacity
    total = sum(w[3] for w in want)
    assert len(places) <= -(-total // capacity) + 1
    assert pack(spark.createDataFrame([], SCHEMA), scratch, WORDS).count() == 0


def test_packed_sequences_hold_the_ids(spark, scratch):
    frame = spark.createDataFrame([(i, "some words here " * i) for i in range(12)], "doc_id long, text string")
    layout = scratch.keep(pack(frame, scratch, WORDS, capacity=16), "layout")
    got = {r.sequence_id: r.ids for r in sequences(frame, layout, WORDS, capacity=16).collect()}
    for r in layout.collect():
        ids = got[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(ids, "<u4")) == r.ids_crc32
    assert all(len(x) <= 16 for x in got.values())


def test_slots_of_equal_lengths():
    where = slots([([(3, 2), (1, 1)], 5), ([(3, 1)], 2)])
    assert where.to_dict("list") == {"length": [1, 3, 3], "first": [0, 0, 10], "copies": [1, 2, 1], "sequence": [0, 0, 5], "offset": [6, 0, 0]}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_lines_of_words_give_each_word_its_ids(name, monkeypatch):
    from ratelab.llm import encoding

    monkeypatch.setattr(encoding, "_LINE", 3)
    words = ["İstanbul", "ǅ", "ﬁne", "ſ", "ª", "ẞ", "ŉ", "ΐ", "क़", "各位", "كتاب", "ไทย", "x", "Unbelievable", "a" * 500, "naïve", "𝒜"]
    own = encoding.Encoder(encoding.vocabulary(name))
    for lead in (" ", ""):
        got = own._lines(words, lead)
        assert got == [own._plain([lead + w])[0] for w in words]
    for text in (" ".join(words * 3), "\n".join(words), ", ".join(words)):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own._tokenizer.encode(text, add_special_tokens=False).ids
