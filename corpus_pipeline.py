"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Quality rules, line dedup, near-duplicate removal, benchmark decontamination and
piece encoding. Every stage works on all rows that its predecessor kept, and all
but the last give the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthline.llm import decontaminate, lines, minhash, pieces, quality, queries
from depthline.session import fresh_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio; trusted are those labelled as good."""
    trusted = queries.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.passing(docs, trusted)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of two or more lines that stand earlier; `n_chars` follows the text."""
    out = lines.without_repeats(docs, lines.Rule(pairs=True)).withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id."""
    gone = minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)  # the list grows with the corpus


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_overlaps(docs, queries.table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece ids, their number and the text that they decode to."""
    return pieces.encode(docs, queries.piece_model(), ["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Near duplicates, spaced seeds and piece merges are beyond SQL; tests hold the rows to a brute-force version.
ORACLE_SQL = None


@queries.query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
