"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Patterns give candidates; every candidate's value is hashed and counted over
the distinct repositories and owners that hold it. A value that many owners
share is a copied example; one that few owners hold, and that looks random, is
taken for a live credential, also where no keyword stands beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratelab.llm.common import attach, fresh, numbered, text_or_empty
from ratelab.scratch import Scratch

# Fixed patterns of the base scan; the order is the order of kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run of 18 or more; shorter runs hold no match
HEX = r"[0-9a-f]{16,}"  # likewise
# What the method adds: token-like runs of letters and digits without a keyword.
BARE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = [("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("bare", BARE, 0)]
ASSIGN_VALUE = 12
MANY_OWNERS = 3  # from so many owners on a value counts as a copied example
DISTINCT_CHARS = 8  # a random-looking value has so many different characters
# Redaction asks more of bare runs, which may be paths or hyphenated terms: parts that are plain
# words or numbers aside, so many characters, and case or digits that change at every fifth of them.
PLAIN_PART = r"(?<![A-Za-z0-9])(?:[a-z]+|[A-Z][a-z]*|[A-Z]+|[0-9]+)(?![A-Za-z0-9])|[+/_-]"
CHANGE = r"[a-z](?=[A-Z])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"
KEY_CHARS, KEY_RUN = 16, 5


def key_like(value: Column) -> Column:
    left = F.length(F.regexp_replace(value, PLAIN_PART, ""))
    return (left >= KEY_CHARS) & (F.size(F.regexp_extract_all(value, F.lit(CHANGE), F.lit(0))) * KEY_RUN >= left)


def _found(kind: int, text: str, strict: bool = False) -> Column:
    """Lengths of the gaps before matches, and of each match with its value's hash; null without a match.

    Splitting gives the text between matches, so positions follow from lengths
    in one pass however many matches there are.
    """
    _, pattern, group = KINDS[kind]
    matches = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"),
        ),
        lambda x: F.struct(
            F.length(x["m"]).alias("length"),
            F.length(x["v"]).alias("value_length"),
            F.sha2(x["v"], 256).alias("hash"),
            (x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]")
             & (F.size(F.array_distinct(F.split(x["v"], ""))) >= DISTINCT_CHARS)
             & (key_like(x["v"]) if strict and kind == 3 else F.lit(True))).alias("random"),
        ),
    )
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return F.when(F.col(text).rlike(pattern), F.struct(F.lit(kind).alias("kind"), gaps.alias("gaps"), matches.alias("matches")))


def candidates(scanned: DataFrame) -> DataFrame:
    """``row, owner, repository, kind, start, end, hash, random`` per candidate of stored ``scanned`` rows."""
    each = scanned.select("row", "owner", "repository", F.explode("found").alias("f")).select(
        "row", "owner", "repository", "f.kind", F.posexplode(F.arrays_zip("f.gaps", "f.matches")).alias("pos", "x")
    ).filter("x.matches is not null").select("row", "owner", "repository", "kind", "pos", "x.gaps", "x.matches.*")
    order = Window.partitionBy("row", "kind").orderBy("pos")
    end = F.sum(F.col("gaps") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.col("length"))
    each = each.filter((F.col("kind") != 0) | (F.col("value_length") >= ASSIGN_VALUE))
    # Bare runs count only where they look random and no base span covers them.
    base = F.col("kind") < 3
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return each.withColumn("free", free).filter(base | (F.col("free") & F.col("random"))).select(
        "row", "owner", "repository", "kind", "start", "end", "hash", "random"
    )


def ownership(found: DataFrame) -> DataFrame:
    """``hash, owners, repositories, uses`` per value; a repository belongs to one owner.

    Each step combines before its shuffle, so a value in a third of all rows
    reaches a task as few rows.
    """
    use = found.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    use = use.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"))
    return use.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses")
    )


def scan_spans(
    docs: DataFrame, row: str, text: str, owner: str, repository: str, scratch: Scratch, strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Stored (rows, spans): spans are ``row, kind, start, end, live, owners``, base ones and added ones.

    With ``strict``, bare runs must be ``key_like`` too.
    """
    texts = docs.select(
        F.col(row).alias("row"), F.col(owner).cast("string").alias("owner"), F.col(repository).alias("repository"),
        text_or_empty(text).alias("text"),
    )
    found = F.array(*[_found(k, "text", strict) for k in range(len(KINDS))])
    scanned = texts.select("row", "owner", "repository", F.filter(found, lambda x: x.isNotNull()).alias("found"))
    scanned = scratch.keep(scanned, "scanned")
    each = scratch.keep(candidates(scanned), "candidates")
    owned = scratch.keep(ownership(each), "ownership")
    each = attach(each, owned, ["hash"], "uses", each.count())
    live = (F.col("owners") < MANY_OWNERS) & F.col("random")
    spans = each.withColumn("live", live).filter((F.col("kind") < 3) | F.col("live"))
    return scanned, scratch.keep(spans.select("row", "kind", "start", "end", "live", "owners"), "spans")


def scan_secrets(
    docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
    repository: str = "doc_id",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_bare, n_live, n_example``.

    Spans are ``kind:start:end`` in code points, by start, then kind. Null text
    is empty, null owners count as one owner, a repository is known by its
    owner and ``repository`` together. Rows without a span stay, with empty
    text and zeros; an empty table gives an empty result. Only the named
    columns are read.
    """
    row = fresh(docs, "row")
    docs = docs.select(*dict.fromkeys([doc_id, text, owner, repository])).withColumn(row, F.monotonically_increasing_id())
    docs = docs.select(row, F.col(doc_id), text, F.col(owner).alias("_owner"), F.struct(F.col(repository).alias("repo"), F.col(doc_id).alias("id")).alias("_both"))
    scanned, spans = scan_spans(docs, row, text, "_owner", "_both", scratch)
    names = F.array(*[F.lit(k) for k, _, _ in KINDS])
    label = F.concat_ws(":", F.element_at(names, F.col("kind") + 1), F.col("start"), F.col("end"))
    per_row = spans.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", label.alias("label")))).alias("s"),
        *[F.sum((F.col("kind") == i).cast("long")).alias(f"n_{k}") for i, (k, _, _) in enumerate(KINDS)],
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((F.col("owners") >= MANY_OWNERS).cast("long")).alias("n_example"),
    )
    joined = scanned.select("row", F.col("repository.id").alias("doc_id")).join(per_row, "row", "left")
    text_of = lambda s: F.coalesce(F.array_join(F.transform(s, lambda x: x["label"]), ","), F.lit(""))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        "doc_id", count("n_assign"), count("n_access"), count("n_hex"),
        F.sha2(text_of(F.filter("s", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        text_of(F.col("s")).alias("spans"), count("n_bare"), count("n_live"), count("n_example"),
    )


def redact_secrets(
    docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
    mask: str = "<secret>", shared: bool = True,
) -> DataFrame:
    """All rows and columns of ``docs``; in texts with secrets each span (overlapping ones as one) becomes ``mask``.

    Bare runs are spans only where they are ``key_like``. Without ``shared``,
    values that MANY_OWNERS hold are copied examples and stay, unless a span of
    fewer owners overlaps them; a value of few owners goes, random or not.
    ``n_chars``, if there, follows the new text. Other texts stay as they are.
    """
    stored, row = numbered(docs, scratch, "secret_input")
    both = fresh(stored, "repository")
    keyed = stored.withColumn(both, F.struct(F.col(doc_id).alias("repo"), F.col(doc_id).alias("id")))
    _, spans = scan_spans(keyed, row, text, owner, both, scratch, strict=True)
    spans = spans if shared else spans.filter(F.col("owners") < MANY_OWNERS)
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    # Text kept before each island, as (place, length); the last piece is open.
    order = Window.partitionBy("row").orderBy("start")
    pieces = islands.withColumn("from", F.coalesce(F.lag("end").over(order), F.lit(0)))
    cuts, out = fresh(stored, "cuts"), fresh(stored, "out")
    per_row = pieces.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("from", F.col("start")))).alias(cuts), F.max("end").alias(out)
    ).withColumnRenamed("row", row)
    kept = F.transform(cuts, lambda c: F.substring(F.col(text), c["from"].cast("int") + 1, (c["start"] - c["from"]).cast("int")))
    rest = F.substring(F.col(text), F.col(out).cast("int") + 1, F.length(text))
    changed = F.when(F.col(cuts).isNull(), F.col(text)).otherwise(F.array_join(F.concat(kept, F.array(rest)), mask))
    new = fresh(stored, "changed")
    joined = stored.join(per_row, row, "left").withColumn(new, changed)
    length = F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long")) if "n_chars" in docs.columns else None
    as_new = {text: F.col(new), "n_chars": length}
    return joined.select(*[as_new[c].alias(c) if c in as_new else F.col(c) for c in docs.columns])
