import random

import numpy as np
import pytest

from ratelab.llm import neighbours
from ratelab.llm.neighbours import Plan, hadamard, nearest, rotate

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "v", "i") for i, v in rows], SCHEMA)


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for n, (i, q) in enumerate(ok):
        if i % every == 0:
            best = sorted((-float((q * v).sum()), j) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q))
            out.setdefault(i, []).append([(j, -s) for s, j in best[:k]])
    return out


def recall(got, want):
    lists = {}
    for r in got:
        lists.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i, (own, *_) in want.items():
        hits += len({j for j, _ in own} & lists.get(i, set()))
        total += len(own)
    return hits / total


def test_small_tables_are_exact(spark, scratch, monkeypatch):
    monkeypatch.setattr(neighbours, "SIDE", 7)
    rng = np.random.default_rng(1)
    f = lambda x: [float(y) for y in np.float32(x)]
    rows = [(i, f(rng.normal(size=6) * rng.uniform(0.2, 3))) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # a very common vector
    rows += [(400, None), (401, [0.0] * 6), (402, [float("nan")] * 6), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (404, [float("inf")] * 6), (405, []), (None, rows[1][1])]
    rows += [(500, f(rng.normal(size=3))), (505, f(rng.normal(size=3)))]
    got = nearest(frame(spark, rows), scratch, k=9, every=5).collect()
    lists = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        lists.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, 9, 5)
    assert lists.keys() == want.keys()
    for i, (own,) in want.items():
        assert [j for j, _ in lists[i]] == [j for j, _ in own]
        assert [s for _, s in lists[i]] == pytest.approx([s for _, s in own], rel=1e-12)
    assert all(r.rank >= 1 for r in got)


def test_empty(spark, scratch):
    assert nearest(frame(spark, []), scratch).count() == 0


def test_recall_against_brute_force(spark, scratch):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = nearest(table, scratch).collect()
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    want = {}
    for n in np.flatnonzero(ids % 20 == 0):
        s = x @ x[n]
        s[n] = -9
        want[ids[n]] = [[(j, 0) for j in ids[np.lexsort((ids, -s))[:20]]]]
    assert recall(got, want) >= 0.9
    assert len(got) == 20 * len(want)


def test_probing_few_buckets_of_a_finer_plan_keeps_recall(monkeypatch):
    rng = random.Random(1)
    x = np.random.default_rng(2).normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(neighbours, "BUCKET", 8)
    monkeypatch.setattr(neighbours, "PROBED", 200)
    plan = Plan(len(x), 32, None)
    assert plan.second and plan.probes < 2 * plan.width * 2 * plan.second
    asked = rng.sample(range(4000), 60)
    found = [set() for _ in asked]
    for t in range(neighbours.TABLES):
        own = plan.codes(x, t, 1)[:, 0]
        for i, q in enumerate(plan.codes(x[asked], t, plan.probes)):
            found[i] |= set(np.flatnonzero(np.isin(own, q)).tolist())
    hits = [len(set(np.argsort(-(x @ x[a]))[1:11].tolist()) & found[i]) for i, a in enumerate(asked)]
    assert np.mean(hits) >= 9


def test_rotations_keep_lengths():
    x = np.random.default_rng(3).normal(size=(5, 6))
    for t in range(3):
        assert np.linalg.norm(rotate(x, t, 0, 8), axis=1) == pytest.approx(np.linalg.norm(x, axis=1))
    assert hadamard(hadamard(np.eye(8))) == pytest.approx(np.eye(8))


def test_ties_go_to_the_smallest_ids(spark, scratch, monkeypatch):
    monkeypatch.setattr(neighbours, "SIDE", 40)
    rng = np.random.default_rng(4)
    ids = rng.permutation(600)
    rows = [(int(i), rng.choice([-1.0, 1.0], 8).tolist()) for i in ids]
    lists = {}
    for r in sorted(nearest(frame(spark, rows), scratch, k=7, every=9).collect(), key=lambda r: (r.query_id, r.rank)):
        lists.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert lists == {i: own for i, (own,) in brute(rows, 7, 9).items()}


def test_ties_in_a_block():
    q, v = np.ones((3, 4)), np.ones((900, 4))
    v[::2] *= -1
    first = np.random.default_rng(6).permutation(900)
    i, j, score = neighbours.nearest_of_block(q, v, first, 5)
    assert (score == 4).all() and i.tolist() == sorted([0, 1, 2] * 5)
    assert sorted(first[j[:5]].tolist()) == sorted(first[1::2].tolist())[:5]


def met_share(x, plan, asked, k=20):
    """Share of the true ``k`` nearest that the plan's probes meet."""
    found = [set() for _ in asked]
    at, from_ = plan.lifted(x, False), plan.lifted(x[asked], True)
    for t in range(plan.tables):
        own = plan.codes(at, t, 1)[:, 0]
        for i, q in enumerate(plan.codes(from_, t, plan.probes)):
            found[i] |= set(np.flatnonzero(np.isin(own, q)).tolist())
    hits = 0
    for i, a in enumerate(asked):
        s = x @ x[a]
        s[a] = -np.inf
        hits += len(set(np.argsort(-s)[:k].tolist()) & found[i])
    return hits / k / len(asked)


@pytest.mark.parametrize("n, rotations", [(60_000, 0), (140_000, 1)])
def test_recall_with_production_constants(n, rotations):
    """Random directions, which have no near neighbours, and table vectors with noise."""
    rng = np.random.default_rng(8)
    asked = rng.choice(n, 40, replace=False)
    if not rotations:
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        plan = Plan(n, 64, None)
        assert plan.probes < plan.axes / 8 and not plan.more
        assert met_share(x, plan, asked) >= 0.9
    import pyarrow.parquet as pq

    base = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist())
    x = base[rng.integers(0, len(base), n)]
    x = x + rng.normal(size=x.shape) * 0.3 * np.linalg.norm(x, axis=1, keepdims=True) / x.shape[1] ** 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plan = Plan(n, x.shape[1], None)
    assert len(plan.more) == rotations and plan.probes < plan.axes / 8
    assert met_share(x, plan, asked) >= 0.9


def test_probes_stay_as_many_at_any_size():
    plans = [Plan(10**e, 64, None) for e in range(5, 12)]
    assert max(p.probes for p in plans) <= 2 * neighbours.PROBED / neighbours.BUCKET
    assert all(p.axes * neighbours.BUCKET >= 10**e for e, p in zip(range(5, 12), plans))
    assert max(p.tables for p in plans) < 40


def test_queries_that_meet_too_few_rows_are_searched_in_all(spark, scratch, monkeypatch):
    monkeypatch.setattr(neighbours, "TABLES", 1)
    monkeypatch.setattr(neighbours, "PROBED", 1)
    monkeypatch.setattr(neighbours, "SIDE", 50)
    rng = np.random.default_rng(9)
    rows = [(i, [float(y) for y in np.float32(rng.normal(size=8) * rng.uniform(0.5, 2))]) for i in range(300)]
    lists = {}
    for r in sorted(nearest(frame(spark, rows), scratch, k=290, every=7).collect(), key=lambda r: (r.query_id, r.rank)):
        lists.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, 290, 7)
    assert lists == {i: [j for j, _ in own] for i, (own,) in want.items()}
