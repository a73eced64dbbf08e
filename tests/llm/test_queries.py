"""Registered queries: their SQL, their columns, and native plans."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import compare
from ratelab.llm.queries import ORACLES, QUERIES

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_one_query_per_operator():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES if q != "pipeline"] == list(range(1, 14))
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ok, note = compare(spark, con, sf_dir, name)
    assert ok, note


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op6_secret_scan"])
def test_native(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_planted_runs(spark):
    """Against the contract's words, one by one."""
    import zlib

    from ratelab.llm.queries import with_planted_runs

    texts = {i: " ".join(f"w{j}" for j in range(i % 70)) for i in range(300)} | {301: None, 302: " \n", None: "a b c"}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, w int")
    got = {r["doc_id"]: r["text"] for r in with_planted_runs(docs).collect()}
    assert len(got) == len(texts)
    changed = 0
    for i, text in texts.items():
        words = (text or "").split()
        if i is not None and (h := zlib.crc32(str(i).encode())) % 10 == 0 and words:
            n, g = len(words), h // 10
            a, changed = g % n, changed + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        assert (got[i] or "").split() == words
    assert changed > 10
