import random
import zlib

import numpy as np
import pytest

from ratelab.llm import maxplus
from ratelab.llm.encoding import vocabulary
from ratelab.llm.maxplus import Pieces, decode_ids, encode_documents, encode_texts, marked

MODEL = vocabulary("piece_bpe_32k.model")
PIECES = Pieces(MODEL)


def brute(text):
    """Plain Viterbi over the whole text, first (longest) best piece at each end."""
    s = marked(text)
    best, back = [0.0] + [None] * len(s), [0] * (len(s) + 1)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - PIECES.longest), e):
            w = PIECES.score.get(s[b:e], PIECES.unknown if e == b + 1 else None)
            if w is not None and (best[e] is None or best[b] + w > best[e]):
                best[e], back[e] = best[b] + w, b
    out, e = [], len(s)
    while e:
        out.append(s[back[e] : e])
        e = back[e]
    return [i for p in reversed(out) for i in PIECES.ids(p)]


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "tion", "aaaaaaaa", "in", "x" * 40, "日本語", "é", "😀", "", "\n", "ing\tthe", "1234567890123456789", "ereon", "()" * 9, "abab" * 30]
    return [rng.choice(["", " ", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("chunk,fan", [(16, 3), (17, 64), (40, 2)])
def test_chunks_give_the_ids_of_the_whole(spark, scratch, monkeypatch, chunk, fan):
    monkeypatch.setattr(maxplus, "FAN", fan)
    own = [*texts(chunk), "", " ", "a", "a" * 100, "the end " * 40]
    rows = [(i, t, "k", "n") for i, t in enumerate(own)]
    docs = scratch.keep(spark.createDataFrame(rows, "row long, text string, k string, n string"), "docs")
    found = {}
    for r in encode_texts(docs, scratch, MODEL, "row", "text", chunk).collect():
        found.setdefault(r.row, {})[r.k] = r
    for i, t in enumerate(own):
        got = b"".join(found[i][k].ids for k in sorted(found[i]))
        assert np.frombuffer(got, "<u4").tolist() == brute(t), (t, chunk)
        assert all(x.spelt_right for x in found[i].values())


def test_library_finds_no_better_sum():
    # Told that the model is of the kind whose scores add up, the library searches the same pieces.
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    other = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = random.Random(9)
    for _ in range(300):
        text = " ".join("".join(rng.choice(["th", "e", "tion", "in", "ou", "s", "er"]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 8)))
        own, their = brute(text), other.encode(text)
        total = lambda ids: sum(PIECES.score[PIECES.text[i]] for i in ids)
        assert total(own) >= total(their)
        assert PIECES.decode(own) == PIECES.decode(their)


def test_documents(spark, scratch):
    rows = [(1, "the word " * 9000, "c", "x"), (2, None, "c", "x"), (None, "", "c", "x"), (3, "z" * 70_000, "c", "x"), (3, "a ▁ b", "c", "x"), (4, "▁ x" * 20_000, "c", "x"), (3, "the", "c", "x"), (3, "the", "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, row string")
    got = encode_documents(docs, scratch, MODEL).collect()
    want = []
    for i, t, *_ in rows:
        ids = brute(t or "")
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4")), max(1, -(-(len(t or "") + 1) // maxplus.CHUNK) if len(t or "") >= maxplus.CHUNK else 1), "▁" not in (t or "")))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), scratch, MODEL).count() == 0


def test_decoding(spark):
    rows = [(t, brute(t)) for t in texts(5)] + [(None, None)]
    back = decode_ids(spark.createDataFrame([(i, x[1], "t") for i, x in enumerate(rows)], "i int, ids array<int>, other string"), MODEL).collect()
    assert [r.text for r in sorted(back, key=lambda r: r.i)] == [t for t, _ in rows]


def test_chunks_must_hold_a_piece(spark, scratch):
    with pytest.raises(ValueError):
        encode_texts(spark.createDataFrame([(1, "a")], "row long, text string"), scratch, MODEL, "row", "text", 15)


def test_matrices_combine_associatively():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.3, -np.inf, rng.integers(-9, 9, (4, 4)).astype(float)) for _ in range(3))
    p = maxplus._product
    assert (p([p([a, b]), c]) == p([a, p([b, c])])).all()


def test_units_learnt_together_are_those_of_the_plain_search():
    own = Pieces(MODEL)
    rows = [t for k in range(300, 340) for t in texts(k)] + ["", " ", "a" * 60, "\x00", "b\x00", "é" * 47]
    found = list(own.whole_all(map(marked, rows)))
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in found] == [brute(t) for t in rows]
    assert all(ok for _, ok in found)


def test_whole_documents_are_decoded(monkeypatch):
    # A fault in decoding shows, however the units were remembered.
    own = Pieces(MODEL)
    assert [ok for _, ok in own.whole_all(map(marked, ["the end", "of it"]))] == [True, True]
    own.spelt[own.id["▁it"]] = b"?"
    assert [ok for _, ok in own.whole_all(map(marked, ["the end", "of it"]))] == [True, False]
