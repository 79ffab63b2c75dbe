"""Quality rules: counts of each text, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into buckets. Two multinomials
over the buckets are counted, one from trusted texts and one from the whole raw
corpus; a text's score is the sum of its log ratios divided by the number of its
n-grams. All of it stays in Spark's own functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\x0c\r"
_WORD_GAP = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"
#: Log ratios are whole numbers of this part of a nat, so that sums are exact in any order.
UNIT = 10_000


@dataclass(frozen=True)
class Rule:
    """`buckets` of n-grams, `smoothing` added to each count.

    A text is kept if it doesn't fail the base rules and its log ratio is at
    least `threshold` nats for each n-gram: under it, the raw corpus explains
    the text far better than the trusted texts do. Ids of trusted texts are
    broadcast up to `broadcast_rows` of them (16 bytes each), else shuffled.
    """

    buckets: int = 65_536
    smoothing: float = 0.5
    threshold: float = -0.4
    fewest_words: int = 10
    repeat_percent: int = 20
    broadcast_rows: int = 500_000


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _WORD_GAP), "")


def _hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _pairs(hashes: Column) -> Column:
    """Hash of each word with the next; the last word is hashed with nothing."""
    return F.zip_with(hashes, F.slice(hashes, 2, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _bucket(hash_: Column, rule: Rule) -> Column:
    return F.pmod(hash_, F.lit(rule.buckets)).cast("int")


def n_grams(docs: DataFrame, rule: Rule) -> DataFrame:
    """Column `bucket`: a row for each word and one for each pair of neighbouring words of all texts."""
    tokens = words(F.col("text"))
    zipped = docs.select(tokens.alias("a")).select(F.arrays_zip(F.col("a"), F.slice("a", 2, F.size("a")).alias("b")).alias("z"))
    rows = zipped.select(F.inline("z").alias("a", "b"))
    own = F.xxhash64("a")
    pair = F.xxhash64(own, F.when(F.col("b").isNotNull(), F.xxhash64("b")))
    return rows.select(F.explode(F.array(_bucket(own, rule), _bucket(pair, rule))).alias("bucket"))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and __hashes and __pairs of the words.

    Repeated words: where two hashes of 5-word windows are equal, the hashes are
    sorted together with their places, as one number each; windows with an equal
    neighbour are repeated, and the words that they cover are counted once.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    n = F.size("__words")
    out = docs.withColumn("__words", words(F.col(text))).withColumns(
        {
            "n_words": n.cast("bigint"),
            "word_chars": F.length(F.translate(plain, _SPACE, "")).cast("bigint"),
            "n_symbols": (F.length(plain) - F.length(F.translate(plain, _SYMBOLS, ""))).cast("bigint"),
            "__lines": lines,
            "__hashes": _hashed(F.col("__words")),
            # Places take as many bits as the text needs; the hash has the rest.
            "__bits": F.length(F.bin(n.cast("bigint"))),
        }
    )
    out = out.withColumn("__pairs", _pairs(F.col("__hashes"))).drop("__words")
    window = lambda i: F.xxhash64(F.get(F.col("__pairs"), i), F.get(F.col("__pairs"), i + 2), F.get(F.col("__hashes"), i + 4))
    windows = F.transform(F.sequence(F.lit(0), F.size("__hashes") - 5), window)
    none = F.array().cast("array<bigint>")
    out = out.withColumn("__windows", F.when(F.size("__hashes") > 5, windows).otherwise(none))
    placed = F.transform("__windows", lambda h, i: F.call_function("shiftleft", h, F.col("__bits")) + i)
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    out = out.withColumn("__sorted", F.when(some, F.sort_array(placed)).otherwise(none))
    key = lambda x: F.call_function("shiftright", x, F.col("__bits"))
    beside = lambda x, i: F.coalesce(key(x) == key(F.get(F.col("__sorted"), i)), F.lit(False))
    found = F.filter("__sorted", lambda x, i: beside(x, i - 1) | beside(x, i + 1))
    places = F.transform(found, lambda x: x - F.call_function("shiftleft", key(x), F.col("__bits")))
    out = out.withColumn("__places", F.sort_array(places))
    spans = F.transform("__places", lambda p, i: F.least(F.lit(5), F.coalesce(F.get(F.col("__places"), i + 1) - p, F.lit(5))))
    return out.withColumns(
        {
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_repeat_words": F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, b: a + b),
        }
    ).drop("__lines", "__bits", "__windows", "__sorted", "__places")


def log_ratios(docs: DataFrame, trusted: DataFrame, rule: Rule) -> DataFrame:
    """One row with `weights`, the log ratio of every bucket in units of 1 / UNIT.

    Counts cover all of `docs(doc_id, text)`, and all rows of it whose doc_id is
    in `trusted(doc_id)`. Texts are added up before the shuffle.
    """
    ids = trusted.filter("doc_id is not null").select("doc_id").distinct()
    if ids.count() <= rule.broadcast_rows:
        ids = F.broadcast(ids)
    good = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    raw = n_grams(docs, rule).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"))
    target = n_grams(good, rule).groupBy("bucket").agg(F.count(F.lit(1)).alias("target"))
    buckets = docs.sparkSession.range(rule.buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = buckets.join(raw, "bucket", "left").join(target, "bucket", "left").fillna(0)
    rows = counts.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"))
    added = rule.smoothing * rule.buckets
    ratio = lambda r: (
        F.log((r["target"] + rule.smoothing) / (F.col("n_target") + added)) - F.log((r["raw"] + rule.smoothing) / (F.col("n_raw") + added))
    )
    return rows.select(F.transform("rows", lambda r: F.round(ratio(r) * UNIT).cast("bigint")).alias("weights"))


def scored(docs: DataFrame, trusted: DataFrame, rule: Rule | None = None) -> DataFrame:
    """All columns of `docs`, the base counts, base_failed, score (nats for each n-gram) and kept.

    A null or empty text has no words, fails the base rules and scores 0. Each
    row is judged by itself. Without trusted texts every score is about 0. Names
    with two leading underscores are taken; the result's own names replace
    columns of `docs`.
    """
    rule = rule or Rule()
    weights = log_ratios(docs, trusted, rule).scalar()
    out = base_counts(docs).withColumn("__weights", weights)
    added = lambda total, h: total + F.get(F.col("__weights"), _bucket(h, rule))
    total = F.aggregate("__pairs", F.aggregate("__hashes", F.lit(0).cast("bigint"), added), added)
    failed = (F.col("n_words") < rule.fewest_words) | (100 * F.col("n_repeat_words") > rule.repeat_percent * F.col("n_words"))
    return (
        out.withColumn("base_failed", failed)
        .withColumn("score", F.when(F.size("__hashes") > 0, total / (F.size("__hashes") * F.lit(2.0 * UNIT))).otherwise(F.lit(0.0)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= rule.threshold))
        .drop("__hashes", "__pairs", "__weights")
    )


def passing(docs: DataFrame, trusted: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns.

    A filter on `kept` alone would be moved below the steps that compute it,
    and every step written out again wherever the next one names it, once for
    each word. The row number, which is no function of the row, holds it back.
    """
    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__own"))
    out = scored(own, trusted, rule).withColumn("__row", F.monotonically_increasing_id())
    return out.filter(F.col("kept") & (F.col("__row") >= 0)).select("__own.*")
