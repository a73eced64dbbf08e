"""The operators applied to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratelab.llm import (
    blocknames, chat, html_text, language, maxplus, neighbours, packing, quality, records, repeats, secret_scan, simhash,
    turn_trie,
)
from ratelab.llm.common import table
from ratelab.llm.encoding import vocabulary
from ratelab.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
_WS = r"[\x20\x09-\x0D]+"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"), Scratch(spark))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).table("tokens")
    return records.token_records(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), Scratch(spark), k=20, every=20)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.exact_duplicates(table(spark, sf_dir, "documents"), Scratch(spark)).drop("row")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), Scratch(spark))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxplus.encode_documents(table(spark, sf_dir, "documents"), Scratch(spark), vocabulary("piece_bpe_32k.model"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Scratch(spark), vocabulary("word_bpe_49k.json"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", "fingerprint", "component_id")


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    seqs = turn_trie.share_openings(turn_trie.sequences(table(spark, sf_dir, "conversations")))
    seqs = scratch.keep(seqs, "seqs")
    return turn_trie.ends_digest(seqs, turn_trie.turn_trie(seqs, scratch), scratch).drop("ends")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where the words of every tenth document, by the CRC-32 of its id, repeat from a place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    every = F.filter(F.split(F.col("text"), _WS), lambda w: w != "")
    planted = docs.filter((h % 10 == 0) & F.col("text").isNotNull()).select("doc_id", F.floor(h / 10).alias("g"), every.alias("w"))
    planted = planted.withColumn("n", F.size("w").cast("long")).filter("n > 0")
    planted = planted.withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = planted.select(
        "doc_id",
        F.expr("array_join(transform(sequence(0L, n - 1), i -> w[CAST(if(i < a, i, a + (i - a) % p) AS INT)]), ' ')").alias("text"),
    )
    # Blank texts stay as they are: there is no word to repeat.
    own = ~F.coalesce(h % 10 == 0, F.lit(False)) | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return planted.unionAll(docs.filter(own).select("doc_id", "text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("least"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    start, length, period = -F.col("best.back"), F.col("best.length"), -F.col("best.least")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.expr("1000 * best.length div -best.least")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = language.Vocabulary.load(vocabulary("piece_bpe_32k.model"))
    return language.identify(table(spark, sf_dir, "documents"), pieces, Scratch(spark))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_html_extraction, op3_token_records, op4_nearest_neighbours, op5_exact_dedup,
        op6_secret_scan, op7_quality_classifier, op8_sentencepiece, op9_best_fit_packing, op10_simhash_near_dedup,
        op11_turn_trie, op12_periodic_runs, op13_language_id,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

# Spans of one kind: gaps between matches give the places.
_SPANS = """
    SELECT r, doc_id, source, {kind} AS kind, i,
           sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
           length(m) AS n, v
    FROM (SELECT r, doc_id, source, generate_subscripts(ms, 1) AS i, unnest(gaps[1:len(ms)]) AS g, unnest(ms) AS m, unnest(vs) AS v
          FROM (SELECT r, doc_id, source, regexp_split_to_array(t, {pattern}) AS gaps,
                       regexp_extract_all(t, {pattern}, 0) AS ms, regexp_extract_all(t, {pattern}, {group}) AS vs FROM d))
    WINDOW w AS (PARTITION BY r ORDER BY i)"""
_ASSIGN = (
    "'([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
)

# CRC-32 of a decimal number's text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT),
    lambda c, b: list_reduce(range(8), lambda s, k: xor(s >> 1, (s & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT))"""

ORACLES: dict[str, str] = {
    "op1_chat_formatting": """
        WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
                          count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT conv_id, pos, n,
                     string_agg(coalesce('r' || length(role) || ':' || role, 'n') || coalesce('t' || length(text) || ':' || text, 'n'), '')
                         OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM t),
        f AS (SELECT n, k, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY n, k),
        stay AS (SELECT conv_id, copies FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos = f.n AND p.n > p.pos AND p.k = f.k))
        SELECT conv_id, count(*) AS n_turns, any_value(copies) AS copies,
               string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
        FROM t JOIN stay USING (conv_id) GROUP BY conv_id""",
    "op5_exact_dedup": rf"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op6_secret_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS source, coalesce(text, '') AS t FROM documents),
        every AS ({" UNION ALL ".join(_SPANS.format(kind=k, pattern=p, group=g) for k, (p, g) in enumerate([
            (_ASSIGN, 2), ("'AKIA[A-Z0-9]+'", 0), ("'[0-9a-f]+'", 0), ("'[A-Za-z0-9+/_-]+'", 0)]))}),
        e AS (SELECT r, doc_id, source, kind, s, s + n AS e, v, sha256(v) AS h,
                     regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8 AS random
              FROM every WHERE CASE kind WHEN 0 THEN length(v) >= 12 WHEN 1 THEN n >= 18 WHEN 2 THEN n >= 16 ELSE n >= 20 END),
        c AS (SELECT * FROM e WHERE kind < 3 UNION ALL
              SELECT * FROM e WHERE kind = 3 AND random AND NOT EXISTS (SELECT 1 FROM e AS b WHERE b.r = e.r AND b.kind < 3 AND b.s < e.e AND b.e > e.s)),
        o AS (SELECT h, count(DISTINCT source) AS owners FROM c GROUP BY h),
        a AS (SELECT c.*, o.owners, o.owners < 3 AND random AS live,
                     CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'bare' END || ':' || s || ':' || e AS label
              FROM c JOIN o USING (h) WHERE kind < 3 OR (o.owners < 3 AND random)),
        g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
                     sha256(coalesce(string_agg(label, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256,
                     string_agg(label, ',' ORDER BY s, kind) AS spans, count(*) FILTER (kind = 3) AS n_bare,
                     count(*) FILTER (live) AS n_live, count(*) FILTER (owners >= 3) AS n_example FROM a GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_bare, 0) AS n_bare,
               coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
        FROM d LEFT JOIN g USING (r)""",
    "op11_turn_trie": f"""
        WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
                          ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT c, c - c % 100 AS base, {_CRC.format("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM o)),
        r AS (SELECT ids.c, o.pos AS was, 0 AS own, role, text FROM ids JOIN o ON o.c = base AND pos <= h
              UNION ALL SELECT c, pos, 1, role, text FROM ids JOIN o USING (c) WHERE pos > h),
        t AS (SELECT c, length(text) AS chars, row_number() OVER w AS depth,
                     string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER w AS k
              FROM r WINDOW w AS (PARTITION BY c ORDER BY own, was ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        m AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ended
              FROM (SELECT c, depth, chars, k FROM t UNION ALL SELECT c, 0, 0, '' FROM ids)),
        n AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                     sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256
              FROM m GROUP BY depth, k),
        line AS (SELECT n.depth, n.k, up.depth AS upto, up.k AS above, n.chars * (n.n_convs - 1) AS own,
                        NOT EXISTS (SELECT 1 FROM m JOIN m AS nx ON nx.c = m.c AND nx.depth = m.depth + 1 WHERE m.k = n.k AND m.depth = n.depth) AS leaf
                 FROM n JOIN m AS up ON up.c = n.conv_id AND up.depth <= n.depth),
        s AS (SELECT upto AS depth, above AS k, sum(own) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves,
                     count(*) FILTER (line.depth = upto + 1) AS n_children FROM line GROUP BY ALL)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM n JOIN s USING (depth, k) LEFT JOIN m AS above ON above.c = n.conv_id AND above.depth = n.depth - 1
        LEFT JOIN n AS p ON p.depth = above.depth AND p.k = above.k""",
    "op12_periodic_runs": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC.format("doc_id::VARCHAR")} AS h,
                          list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda w: w <> '') AS w FROM documents),
        e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
        f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM e),
        x AS (SELECT r, doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) AS w FROM f),
        word AS (SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM x),
        same AS (SELECT r, b.i - a.i AS q, a.i FROM word a JOIN word b USING (r, word) WHERE b.i > a.i),
        isle AS (SELECT r, q, min(i) AS s, count(*) + q AS len
                 FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS z FROM same) GROUP BY r, q, z
                 HAVING count(*) + q >= greatest(12, 2 * q)),
        run AS (SELECT r, s, len, min(q) AS q FROM isle GROUP BY r, s, len),
        gone AS (SELECT DISTINCT word.r, i FROM word JOIN run ON run.r = word.r AND i >= s + q AND i < s + len),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r),
        best AS (SELECT r, count(*) AS n_runs, arg_max({{'s': s, 'len': len, 'q': q}}, [len, -s, -q]) AS b,
                        sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256 FROM run GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.len AS length, b.q AS period, 1000 * b.len // b.q AS exponent_milli,
               coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM x LEFT JOIN best USING (r) LEFT JOIN kept USING (r)""",
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
