"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words at the kept positions of a mask laid over the
text; the positions that the mask ignores may differ. Seeds of the benchmark
are looked up in every document, and around each hit the benchmark item is laid
over the document word by word: a passage counts as found where enough of the
words in a row of `overlap` agree. Substituted words are tolerated, by the mask
in the search and by the share in the verification.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthline.llm import kernels as K
from depthline.session import materialise

U = np.uint64
#: Fixed masks over 10 words, 1 = kept (fixed values). Wherever one or two of 13 words in a row are replaced, a mask fits.
MASKS = ("1110110011", "1100011111", "1011010111", "1101111001")


@dataclass(frozen=True)
class Rule:
    """Masks, and what a verified passage is.

    Ids of hit documents are broadcast up to `broadcast_rows` of them (16 bytes
    each), else joined by a shuffle.

    `overlap` words in a row (or a whole item that is shorter) must lie over the
    document with at least `percent` of them equal. Benchmark rows are taken in
    blocks of about `block_bytes`: the size bound of what is sent to the tasks.
    """

    masks: tuple[str, ...] = MASKS
    overlap: int = 13
    percent: int = 80
    block_bytes: int = 8_000_000
    broadcast_rows: int = 500_000


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buf = K.lower_ascii(buf)
    start, end, bounds = K.words(buf, off)
    return K.span_hash(buf, start, end), bounds


def _masked(tokens: np.ndarray, kept: list[int], width: int, number: int) -> np.ndarray:
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, U(number + 1))
    for k in kept:
        total += tokens[k : k + n] * U((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1)
    return K.mix(total)


class Seeds:
    """The seeds of one block of the benchmark, sorted, behind a bit table."""

    def __init__(self, items: list[int], texts: list[str | None], rule: Rule):
        self.rule = rule
        self.items = np.array(items, np.int64)
        self.tokens, self.bounds = _tokens(*K.text_bytes(pa.array(texts, pa.string())))
        self.shapes = [([k for k, c in enumerate(m) if c == "1"], len(m)) for m in rule.masks]
        found = []
        for number, (kept, width) in enumerate(self.shapes):
            at, counts = K.inside(self.bounds, width)
            found.append((_masked(self.tokens, kept, width, number)[at], at, np.repeat(np.arange(len(self.items)), counts)))
        n_words = np.diff(self.bounds)
        shapes = [(kept, width, n) for n, (kept, width) in enumerate(self.shapes)]
        # A shorter item is cut into one part more than it may have replaced words, so a part is whole.
        for n in sorted({int(n) for n in n_words if 0 < n < rule.overlap}):
            own = np.flatnonzero(n_words == n)
            parts = n - -(-n * rule.percent // 100) + 1
            for k, part in enumerate(np.array_split(np.arange(n), parts)):
                shapes.append((part.tolist(), n, 1000 * n + k))
                found.append((_masked(self.tokens, *shapes[-1])[self.bounds[own]], self.bounds[own], own))
        self.shapes = shapes
        self.seed, self.place, self.item = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.place, self.item = self.seed[order], self.place[order], self.item[order]
        self.bits = max(16, int(len(self.seed) * 16).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.seed >> U(64 - self.bits)).astype(np.int64)] = True

    def hits(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item, and the place of the item's first word in the block, each once."""
        out = []
        for kept, width, number in self.shapes:
            seeds = _masked(tokens, kept, width, number)
            some = np.flatnonzero(self.table[(seeds >> U(64 - self.bits)).astype(np.int64)])
            if not len(some):
                continue
            doc = np.searchsorted(bounds, some, side="right") - 1
            whole = some + width <= bounds[doc + 1]
            some, doc = some[whole], doc[whole]
            lo, hi = np.searchsorted(self.seed, seeds[some]), np.searchsorted(self.seed, seeds[some], side="right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            item = self.item[at]
            out.append(np.stack([np.repeat(doc, n), item, np.repeat(some, n) - (self.place[at] - self.bounds[item])]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.unique(np.concatenate(out, axis=1), axis=1))

    def verify(self, tokens: np.ndarray, lo: int, hi: int, item: int, origin: int) -> tuple[int, int, int] | None:
        """Equal words, first and end word in the document, of the item laid at `origin`; None if it fails."""
        words = self.tokens[self.bounds[item] : self.bounds[item + 1]]
        first, end = max(origin, lo), min(origin + len(words), hi)
        need = min(self.rule.overlap, len(words))
        if end - first < need:
            return None
        same = tokens[first:end] == words[first - origin : end - origin]
        total = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(100 * (total[need:] - total[:-need]) >= self.rule.percent * need)
        if not len(good):
            return None
        mark = K.covered(good, need, len(same))
        at = np.flatnonzero(mark)
        return int((same & mark).sum()), first + int(at[0]), first + int(at[-1]) + 1


def _blocks(benchmark: DataFrame, rule: Rule) -> Iterator[tuple[list[int], list[str | None]]]:
    """The benchmark in bounded pieces, one after the other on the driver."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and text is not null")
    items, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        items.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
        if size >= rule.block_bytes:
            yield items, texts
            items, texts, size = [], [], 0
    if items:
        yield items, texts


def overlaps(docs: DataFrame, benchmark: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, item_id, n_equal, first_word and end_word of each passage found.

    `docs(doc_id, text)` against `benchmark(item_id, text)`; one row for each
    document and item, of its passage with the most equal words, the earliest of
    equals. Documents are never shuffled: each block of the benchmark goes to
    all tasks. Null and empty texts hold nothing; a null item_id is left out, a
    null doc_id comes back as null. Repeated rows of `docs` give repeated rows,
    repeated items one row. Other columns are not looked at.
    """
    rule = rule or Rule()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, n_equal bigint, first_word bigint, end_word bigint"
    spark = docs.sparkSession
    found = [spark.createDataFrame([], schema)]
    for items, texts in _blocks(benchmark, rule):
        sent = spark.sparkContext.broadcast((items, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(*sent.value, rule)
            for batch in batches:
                buf, off = K.text_bytes(batch["text"])
                out = []
                for i, j in K.blocks(off):
                    tokens, bounds = _tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                    best: dict[tuple[int, int], tuple[int, int, int]] = {}
                    for doc, item, origin in zip(*(x.tolist() for x in seeds.hits(tokens, bounds))):
                        lo = int(bounds[doc])
                        if (seen := seeds.verify(tokens, lo, int(bounds[doc + 1]), item, origin)) is not None:
                            key = (doc, int(seeds.items[item]))
                            now = (-seen[0], seen[1] - lo, seen[2] - lo)
                            best[key] = min(best.get(key, now), now)
                    out += [(i + d, item, -n, a, b) for (d, item), (n, a, b) in best.items()]
                if out:
                    at, item, n, a, b = (np.array(x, np.int64) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(pa.array(at)), *(pa.array(x) for x in (item, n, a, b))],
                        ["doc_id", "item_id", "n_equal", "first_word", "end_word"],
                    )

        found.append(rows.mapInArrow(run, schema))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def without_overlaps(docs: DataFrame, benchmark: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The rows of `docs`, all columns, that hold no passage of the benchmark."""
    rule = rule or Rule()
    hit = materialise(overlaps(docs, benchmark, rule).select("doc_id").distinct(), "leaks")
    hit = F.broadcast(hit) if hit.count() <= rule.broadcast_rows else hit.hint("merge")
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)
