"""The pipeline against a plain version of each stage, and what a missing subpackage leaves."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from ratelab.llm import quality
from ratelab.llm.encoding import vocabulary
from ratelab.scratch import Scratch
from tests.llm.test_duplicates import brute_components, normal
from tests.llm.test_secrets_quality import brute_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, print string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Given documents with more copies, secrets and odd rows, and their labels."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(260).collect()]
    rng = random.Random(1)
    texts = [d[1] for d in docs if d[1] and len(d[1]) > 1500]
    more = []
    for i in range(40):
        words = rng.choice(texts).split(" ")
        words[rng.randrange(len(words))] = "changed"
        more.append((10_000 + i, " ".join(words), "en", f"src{i % 4}", 5))
    more += [(20_000 + i, texts[0].replace(" ", "  "), "en", "src1", 5) for i in range(30)]
    more += [(30_000, None, None, None, None), (None, texts[1] + " more", "en", "src2", 1), (30_001, "token = 'abcDEF1234567890xyz' " + texts[2], "en", "src3", 7), (30_002, "", "en", "src1", 0)]
    spark.createDataFrame([(*d, "r", "p") for d in docs + more], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages_against_plain_ones(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    with Scratch(spark) as scratch:
        made = [docs]
        for name, stage in corpus_pipeline.STAGES:
            made.append(scratch.keep(stage(spark, made[-1], tables), name))
        assert all(m.columns == docs.columns for m in made[1:-1])
        start, good, single, apart, masked = (rows(m) for m in made[:-1])

        weights = quality.train(docs, labels)
        keeps = lambda t: 1 / (1 + math.exp(-(quality._SCALE * quality.dot(t, weights[:-1]) + weights[-1]))) >= 0.7
        assert sorted(map(repr, good)) == sorted(repr(r) for r in start if keeps(r[1]))
        assert 0 < len(good) < len(start)

        best = {}
        for i, t, s in good:
            key = normal(t)
            if key not in best or (i is not None and (best[key][0] is None or i < best[key][0])):
                best[key] = (i, t, s)
        assert sorted(map(repr, single)) == sorted(map(repr, best.values()))

        heads = {c: None for _, _, c in brute_components([(i, t) for i, t, _ in single])}
        assert sorted(repr(r[0]) for r in apart) == sorted(map(repr, heads))
        assert set(map(repr, apart)) <= set(map(repr, single)) and len(apart) < len(single)

        want = []
        for n, (i, t, s) in enumerate(apart):
            for a, b in reversed(brute_spans(apart, n)):
                t = t[:a] + "<secret>" + t[b:]
            want.append((i, t, s))
        assert sorted(map(repr, masked)) == sorted(map(repr, want)) and any("<secret>" in (t or "") for _, t, _ in masked)

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
        pieces = []
        for i, t, _ in masked:
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            pieces += [(i, p, at, min(4096, len(ids) - at), zlib.crc32(ids[at : at + 4096])) for p, at in enumerate(range(0, len(ids), 4096))]
        packed = made[-1].collect()
        assert sorted(map(repr, pieces)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in packed)
        places = {}
        for r in packed:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in places.values():
            own.sort()
            assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(own[-1]) <= 4096
        assert len(places) <= -(-sum(p[3] for p in pieces) // 4096) + 1


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
