"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthline.llm import boundaries, decontaminate, language, licences, lines, minhash, pieces, prefixtrie
from depthline.llm import quality, substrings, suffix, warc, wordbpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), piece_model(), ["doc_id"])


@query("op1_superminhash")
def op1_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs, minhash.Rule(words=3, percent=85))


@query("op3_spaced_seeds")
def op3_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents"))


_WARC_ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, h,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, CAST(i // 8 * 10 + 1 AS BIGINT), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
         max(page_id) OVER (PARTITION BY h, payload_bytes) AS holder
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM d
"""


@query("op9_warc", _WARC_ORACLE)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archived(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_licences", licences.oracle())
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    out = quality.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


@query("op7_line_chunks", lines.ORACLE)
def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.without_repeats(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


@query("op2_suffix_arrays")
def op2_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"), digests=True)


@query("op5_seed_extend")
def op5_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"), digests=True)


@query("op11_boundaries", boundaries.ORACLE)
def op11_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = boundaries.transform(table(spark, sf_dir, "documents"))
    whole = boundaries.restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"),
    )


@query("op12_distinct_words")
def op12_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.encode_digests(table(spark, sf_dir, "documents"), word_model(), ["doc_id"])


@query("op13_zfast_trie", prefixtrie.ORACLE)
def op13_zfast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixtrie.turn_rows(table(spark, sf_dir, "conversations"))
    return prefixtrie.nodes(*prefixtrie.shared_heads(turns))
