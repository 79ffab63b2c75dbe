"""Removal of repeated content-defined chunks of lines.

A rolling hash over the hashes of the last three lines cuts each text into
chunks: a line ends a chunk where the rolling hash falls in a fixed class. The
cuts depend on the lines nearby alone, so texts that share a passage share its
chunks wherever it stands. Of equal chunks of two or more lines anywhere in the
corpus the first one stays. Hashes find the candidates; the chunks themselves
are then the keys of a grouping and a join, which compare them byte by byte.

Cuts miss what a passage shares before its first cut and after its last one, and
one-line chunks. With `pairs`, every two lines in a row are a chunk as well, so
any run of two or more lines that stands earlier in the corpus goes whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthline.session import materialise

_PRIME = 2_147_483_647


@dataclass(frozen=True)
class Rule:
    """A chunk ends at about one line in `every`; removed chunks have `fewest` lines or more.

    Hashes of repeated chunks are broadcast up to `broadcast_rows` of them (16
    bytes each), else joined by a shuffle. With `pairs`, lines of a repeated pair
    of neighbouring lines go too, unless both are blank.
    """

    every: int = 3
    fewest: int = 2
    broadcast_rows: int = 1_000_000
    pairs: bool = False


def line_hash(line: Column) -> Column:
    """31-bit hash of a line that any SQL engine has: the head of its MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint") % _PRIME


def chunked(docs: DataFrame, rule: Rule) -> DataFrame:
    """`docs` with __lines, and __spans: first place and end of each chunk in order."""
    out = docs.withColumn("__lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    out = out.withColumn("__hashes", F.transform("__lines", line_hash))
    n = F.size("__lines")
    back = lambda e, k: F.coalesce(F.get(F.col("__hashes"), e - 1 - k), F.lit(0))
    ends = F.filter(
        F.sequence(F.lit(1), n),
        lambda e: (e == n) | (((back(e, 0) + 31 * back(e, 1) + 961 * back(e, 2)) % _PRIME) % rule.every == 0),
    )
    out = out.withColumn("__ends", ends)
    begin = lambda i: F.coalesce(F.get(F.col("__ends"), i - 1), F.lit(0))
    spans = F.transform("__ends", lambda e, i: F.struct(begin(i).alias("a"), e.alias("e")))
    return out.withColumn("__spans", spans).drop("__hashes", "__ends")


def chunk_text(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span["a"] + 1, span["e"] - span["a"]), "\n")


def _pieces(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, chunk (its end), n_lines, pair, hash and piece of each chunk that may be removed."""
    known = docs.filter("doc_id is not null").select("doc_id", "text")
    rows = chunked(known, rule)
    long = F.filter("__spans", lambda s: s["e"] - s["a"] >= rule.fewest)
    rows = rows.select("doc_id", "__lines", F.explode(long).alias("s"))
    rows = rows.select(
        "doc_id",
        F.col("s.e").alias("chunk"),
        (F.col("s.e") - F.col("s.a")).alias("n_lines"),
        F.lit(False).alias("pair"),
        chunk_text(F.col("__lines"), F.col("s")).alias("piece"),
    )
    if rule.pairs:
        rows = rows.unionByName(_pairs(known))
    return rows.withColumn("hash", F.xxhash64("piece"))


def _pairs(docs: DataFrame) -> DataFrame:
    """Every two neighbouring lines of which one is not blank, as a chunk of two lines."""
    lines = docs.select("doc_id", F.split("text", "\n").alias("ls")).filter(F.size("ls") > 1)
    pair = lambda e: F.concat(F.get(F.col("ls"), e - 2), F.lit("\n"), F.get(F.col("ls"), e - 1))
    ends = F.transform(F.sequence(F.lit(2), F.size("ls")), lambda e: F.struct(e.alias("chunk"), pair(e).alias("piece")))
    rows = lines.select("doc_id", F.inline(ends)).filter(F.col("piece").rlike("\\S"))
    return rows.select("doc_id", "chunk", F.lit(2).alias("n_lines"), F.lit(True).alias("pair"), "piece")


def repeated(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, chunk and n_lines of every chunk that equals an earlier one, by doc_id and then place.

    Pairs overlap; one that shares a line with the first of its kind is no repeat.
    """
    pieces = _pieces(docs, rule)
    found = pieces.groupBy("hash", "pair").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", "pair")
    found = materialise(found, "chunks")
    if found.count() <= rule.broadcast_rows:
        found = F.broadcast(found)
    some = pieces.join(found, ["hash", "pair"], "left_semi")
    key = ["hash", "pair", "piece"]
    firsts = some.groupBy(*key).agg(F.min(F.struct("doc_id", "chunk")).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.filter("n > 1").drop("n")
    apart = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("chunk") - F.col("first.chunk") >= F.col("n_lines"))
    return some.join(firsts, key).filter(apart).select("doc_id", "chunk", "n_lines")


def without_repeats(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """`docs(doc_id, text)` without repeated chunks; n_lines and n_removed are added.

    All columns stay; `text` has the kept lines joined by line ends, and is empty
    if none is left. Null texts stay null and have no lines, empty ones have one
    empty line. Rows with a null doc_id stay as they are and count for nothing;
    rows that repeat a doc_id count as one. Names with two leading underscores
    are taken, and columns n_lines and n_removed of `docs` are replaced.

    A line goes with any repeated chunk that holds it; the first place of a line
    in the corpus always stays, as each removal points to an earlier one.
    """
    rule = rule or Rule()
    gone = materialise(repeated(docs, rule), "repeats")
    gone = gone.select("doc_id", F.sequence(F.col("chunk") - F.col("n_lines") + 1, F.col("chunk")).alias("at"))
    gone = gone.groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("__gone"))
    rest = docs.drop("n_lines", "n_removed")
    # The list grows with the corpus, so it is never broadcast, however small it looks.
    rows = rest.join(gone.hint("merge"), "doc_id", "left")
    rows = rows.withColumn("__lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    changed = F.col("__gone").isNotNull() & F.col("text").isNotNull()
    left = F.array_except(F.sequence(F.lit(1), F.size("__lines")), "__gone")
    rows = rows.withColumn("__left", F.when(changed, left))
    text = F.array_join(F.transform("__left", lambda i: F.get(F.col("__lines"), i - 1)), "\n")
    out = rows.withColumns(
        {
            "text": F.when(changed, text).otherwise(F.col("text")),
            "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("bigint"),
            "n_removed": F.when(changed, F.size("__lines") - F.size("__left")).otherwise(F.lit(0)).cast("bigint"),
        }
    )
    return out.select(*rest.columns, "n_lines", "n_removed")


ORACLE = f"""
WITH l AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), h AS (
  SELECT *, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {_PRIME}) AS hs FROM l
), e AS (
  SELECT *, unnest(list_filter(range(1, len(ls) + 1), lambda e: e = len(ls) OR ((hs[e]
           + 31 * CASE WHEN e > 1 THEN hs[e - 1] ELSE 0 END + 961 * CASE WHEN e > 2 THEN hs[e - 2] ELSE 0 END) % {_PRIME}) % 3 = 0)) AS e
  FROM h
), s AS (
  SELECT doc_id, text, ls, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY e), 0) AS a FROM e
), p AS (
  SELECT doc_id, text, e, e - a AS n, array_to_string(ls[a + 1 : e], chr(10)) AS piece FROM s
), r AS (
  SELECT *, n >= 2 AND row_number() OVER (PARTITION BY piece, n >= 2 ORDER BY doc_id, e) > 1 AS gone FROM p
)
SELECT doc_id, CASE WHEN any_value(text) IS NULL THEN 0 ELSE sum(n)::BIGINT END AS n_lines,
       coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(piece, chr(10) ORDER BY e) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
