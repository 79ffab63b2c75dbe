"""Anchors: content-chosen marks that lead every repeated window of a corpus to one place.

Each window of a text has as its anchor the least hash among its grams, so equal
windows have equal anchors. A run is a stretch of windows with one anchor. Two
rounds find repeats without shipping the corpus. The first counts anchors only,
and says which anchors of a document occur elsewhere. The second sends the runs
of those anchors, with their content, to the shard of their anchor.

Frequent anchors: a batch of texts sends one entry for an anchor, or for a run's
content, however often it holds it, and settles what it can settle by itself.
An anchor with more entries than `Rule.heavy` has its windows dealt out one by
one by their own hashes, to as many shards as it needs.

Shards are as many as the texts need, however many partitions the session has, and
a task gets one of them, so that what it holds does not grow with the corpus.

What a shard has found goes back to the documents by mail: one row from a task to
a bucket of documents, whose mail is then put together, one row a document. A row
for each document and shard would grow with the product of the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthline.llm import kernels as K
from depthline.session import materialise

U = np.uint64
#: Bytes of text that a shard stands for; its runs have about as many bytes, and less than four times as many.
SHARD_BYTES = 16_000_000


@dataclass(frozen=True)
class Rule:
    """`window` units (bytes or words) that repeat, searched by grams of `gram` units.

    `distinct_docs`: a repeat has to lie in two documents, else any two places
    count. Heavy anchors have at least `heavy` entries, or a millionth of all
    entries if that is more, so that their list stays below a million rows.
    `batch_bytes` of text are settled at a time.
    """

    window: int
    gram: int
    distinct_docs: bool
    heavy: int = 200_000
    batch_bytes: int = 4_000_000

    @property
    def width(self) -> int:
        return self.window - self.gram + 1


@dataclass
class Runs:
    """Runs of a block: text, first window, number of windows, anchor, and the anchor's place where it is known."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    place: np.ndarray

    def take(self, some: np.ndarray) -> Runs:
        return Runs(*(x[some] for x in (self.doc, self.start, self.count, self.anchor, self.place)))


def runs_of(grams: np.ndarray, bounds: np.ndarray, rule: Rule, placed: bool) -> Runs:
    """Runs of the texts whose units lie in `bounds`; `grams` are 32-bit hashes at every unit.

    With `placed`, an anchor is the leftmost of its equals, and a run ends where
    its place changes.
    """
    at, counts = K.inside(bounds, rule.window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, np.zeros(0, np.uint32), none)
    value = (grams.astype(U) << U(32)) | np.arange(len(grams), dtype=U) if placed else grams
    least = K.sliding_min(value, rule.width)[at]
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.ones(len(at), bool)
    first[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(first)
    anchor = (least[cut] >> U(32)).astype(np.uint32) if placed else least[cut]
    place = (least[cut] & U(0xFFFFFFFF)).astype(np.int64) if placed else np.full(len(cut), -1)
    return Runs(doc[cut], at[cut], np.diff(np.append(cut, len(at))), anchor, place)


Split = Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, int, Runs, dict]]]


def _first_of(order_by: np.ndarray) -> np.ndarray:
    first = np.ones(len(order_by), bool)
    first[1:] = order_by[1:] != order_by[:-1]
    return np.flatnonzero(first)


_ASK, _SURE, _MAIL = 0, 1, 2


def shards_for(docs: DataFrame) -> int:
    """A shard for every `SHARD_BYTES` of text, and no fewer than the session's partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """Rows by their shard, each in a partition of its own; hashes would put several into one and leave others empty."""
    return rows.repartitionById(shards, F.col("shard").cast("int"))


def shared_anchors(docs: DataFrame, rule: Rule, split: Split, shards: int | None = None) -> DataFrame:
    """Mail to documents with their anchors that occur elsewhere; and heavy anchors.

    A row with a null bucket has heavy anchors and, in `weights`, their numbers
    of entries.
    """
    shards = shards or shards_for(docs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            buf, off = K.text_bytes(batch["text"])
            for i, j in K.blocks(off, rule.batch_bytes):
                parts = [(r.doc + i + a, r.anchor) for a, _, r, _ in split(buf[off[i] : off[j]], off[i : j + 1] - off[i])]
                doc = ids[np.concatenate([p[0] for p in parts])]
                anchor = np.concatenate([p[1] for p in parts])
                if not len(doc):
                    continue
                order = np.lexsort((doc, anchor))
                doc, anchor = doc[order], anchor[order]
                if rule.distinct_docs:
                    own = np.ones(len(doc), bool)
                    own[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                    doc, anchor = doc[own], anchor[own]
                first = _first_of(anchor)
                n = np.diff(np.append(first, len(anchor)))
                many = np.repeat(n > 1, n)
                out = [*_packed(_ASK, doc[~many], anchor[~many], shards), *_weighed(anchor[first[n > 1]], n[n > 1], shards)]
                if many.any():  # known here and now
                    out += [{"kind": _MAIL, "shard": r["bucket"], **r} for r in mailed(doc[many], anchor[many], shards)]
                yield pa.RecordBatch.from_pylist(out, _ASKED)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, anchor, heavy, weight, settled = [], [], [], [], []
        for batch in batches:
            mail = pa.compute.equal(batch["kind"], _MAIL)
            settled.append(mail_of(batch.filter(mail)))
            for row in batch.filter(pa.compute.invert(mail)).to_pylist():
                a = np.frombuffer(row["anchors"], np.uint32)
                c = np.frombuffer(row["counts"], np.int32)
                if row["kind"] == _ASK:
                    doc.append(np.repeat(np.frombuffer(row["docs"], np.int64), c))
                    anchor.append(a)
                else:
                    heavy.append(a)
                    weight.append(c)
        if not settled:
            return
        none = np.zeros(0, np.int64)
        doc, anchor = np.concatenate([none, *doc]), np.concatenate([none.astype(np.uint32), *anchor])
        sure, times = np.concatenate([none.astype(np.uint32), *heavy]), np.concatenate([none, *weight]).astype(np.int64)
        order = np.argsort(anchor, kind="stable")
        doc, anchor = doc[order], anchor[order]
        first = _first_of(anchor)
        n = np.diff(np.append(first, len(anchor)))
        value = anchor[first]
        if rule.distinct_docs and len(first):
            twice = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        else:
            twice = n > 1
        twice = twice | np.isin(value, sure)
        known = np.repeat(twice, n)
        settled.append((doc[known], anchor[known].view(np.int32)))
        rows = mailed(*(np.concatenate(x) for x in zip(*settled)), shards)
        every, place = np.unique(np.concatenate([value, sure]), return_inverse=True)
        total = np.bincount(place, np.concatenate([n, times])).astype(np.int64)
        big = total >= rule.heavy
        if big.any():
            rows.append({"heavy": every[big].view(np.int32), "weights": total[big]})
        yield pa.RecordBatch.from_pylist(rows, _ANSWERED)

    asked = docs.select("doc_id", "text").mapInArrow(ask, f"kind int, shard int, anchors binary, {MAIL_SQL}")
    # What a batch knows for certain passes through the same shuffle, dealt by bucket.
    answered = dealt(asked, shards).mapInArrow(answer, f"{MAIL_SQL}, heavy array<int>, weights array<bigint>")
    return materialise(answered, "anchors")


#: Columns of mail: a bucket of documents, its documents, how many values each has, and the values, of 32 bits.
MAIL = [("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("mail", pa.binary())]
MAIL_SQL = "bucket int, docs binary, counts binary, mail binary"
_ASKED = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("anchors", pa.binary()), *MAIL])
_ANSWERED = pa.schema([*MAIL, ("heavy", pa.list_(pa.int32())), ("weights", pa.list_(pa.int64()))])


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (K.mix(key.astype(U)) % U(shards)).astype(np.int64)


def _packed(kind: int, doc: np.ndarray, anchor: np.ndarray, shards: int) -> list[dict]:
    """A row for each shard: its documents in order, how many anchors each has, and the anchors."""
    shard = _shard(anchor, shards)
    order = np.lexsort((doc, shard))
    doc, anchor, shard = doc[order], anchor[order], shard[order]
    out = []
    cuts = np.append(_first_of(shard), len(shard)) if len(shard) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        first = _first_of(doc[a:b])
        n = np.diff(np.append(first, b - a)).astype(np.int32)
        out.append(
            {"kind": kind, "shard": int(shard[a]), "docs": doc[a:b][first].tobytes(), "counts": n.tobytes(), "anchors": anchor[a:b].tobytes()}
        )
    return out


def _weighed(anchor: np.ndarray, n: np.ndarray, shards: int) -> list[dict]:
    shard = _shard(anchor, shards)
    order = np.argsort(shard, kind="stable")
    anchor, n, shard = anchor[order], n[order].astype(np.int32), shard[order]
    cuts = np.append(_first_of(shard), len(shard)) if len(shard) else [0]
    return [
        {"kind": _SURE, "shard": int(shard[a]), "counts": n[a:b].tobytes(), "anchors": anchor[a:b].tobytes()}
        for a, b in zip(cuts[:-1], cuts[1:])
    ]


def mailed(doc: np.ndarray, values: np.ndarray, buckets: int) -> list[dict]:
    """Mail with a value (or row of values) for each of `doc`, one row for each bucket that has any."""
    bucket = _shard(doc, buckets)
    order = np.lexsort((doc, bucket))
    doc, values, bucket = doc[order], values[order], bucket[order]
    first = _first_of(doc)
    edge = np.append(first, len(doc))
    n = np.diff(edge).astype(np.int32)
    cuts = np.append(_first_of(bucket[first]), len(first)).tolist()
    return [
        {
            "bucket": int(bucket[first[a]]),
            "docs": doc[first[a:b]].tobytes(),
            "counts": n[a:b].tobytes(),
            "mail": values[edge[a] : edge[b]].tobytes(),
        }
        for a, b in zip(cuts[:-1], cuts[1:])
    ]


def mail_of(rows: pa.RecordBatch | pa.Table, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Documents and values of mail; with a `width`, rows of so many values."""
    kinds = (("docs", np.int64), ("counts", np.int32), ("mail", np.int32))
    doc, n, values = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in rows[c].to_pylist())]) for c, t in kinds)
    return np.repeat(doc, n), values if width == 1 else values.reshape(-1, width)


def mailed_spans(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and spans, as rows of start and end, of what `span_rows` gives."""
    pairs = np.frombuffer(b"".join(s for _, s in rows), np.int64).reshape(-1, 2).astype(np.int32)
    return np.repeat(np.array([d for d, _ in rows], np.int64), [len(s) // 16 for _, s in rows]), pairs


def spans_by_document(mail: DataFrame) -> DataFrame:
    """doc_id and spans (merged pairs of start and end as bytes) of mail with spans, one row a document."""

    def merged(rows: pa.Table) -> pa.Table:
        doc, pairs = mail_of(rows, 2)
        found = span_rows(doc, *pairs.astype(np.int64).T)
        return pa.table({"doc_id": pa.array([d for d, _ in found], pa.int64()), "spans": pa.array([s for _, s in found], pa.binary())})

    return mail.groupBy("bucket").applyInArrow(merged, "doc_id bigint, spans binary")


def heavy_anchors(shared: DataFrame, rule: Rule) -> dict[int, int]:
    """Heavy anchors and into how many parts each is dealt; fewer than a million.

    An entry has up to `width` windows, so that a part has no more windows than a
    light anchor has entries.
    """
    rows = shared.filter("bucket is null").select(F.explode(F.arrays_zip("heavy", "weights")).alias("x")).select("x.heavy", "x.weights")
    total = rows.agg(F.sum("weights")).first()[0] or 0
    limit = max(rule.heavy, total // 1_000_000)
    found = rows.filter(F.col("weights") >= limit).collect()
    return {int(np.uint32(r[0] & 0xFFFFFFFF)): 1 + int(r[1] * rule.width // limit) for r in found}


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (bigint) and text; without a projection where none is needed, so that Spark finds equal shuffles equal."""
    rows = docs.select("doc_id", "text")
    return rows if rows.schema["doc_id"].dataType.typeName() == "long" else rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def known_texts(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, text and known (array<int>): documents with anchors that occur elsewhere."""

    def lists(rows: pa.Table) -> pa.Table:
        doc, anchor = mail_of(rows)
        order = np.argsort(doc, kind="stable")
        doc, anchor = doc[order], anchor[order]
        first = _first_of(doc)
        known = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(anchor))
        return pa.table({"doc_id": doc[first], "known": known})

    mail = shared.filter("bucket is not null").select("bucket", "docs", "counts", "mail")
    known = mail.groupBy("bucket").applyInArrow(lists, "doc_id bigint, known array<int>")
    return docs.join(known, "doc_id").select("doc_id", "text", "known")


def known_runs(runs: Runs, keys: np.ndarray) -> Runs:
    """The runs whose (text, anchor) is among the sorted `keys`."""
    if not len(keys):
        return runs.take(np.zeros(0, np.int64))
    own = (runs.doc.astype(U) << U(32)) | runs.anchor.astype(U)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return runs.take(np.flatnonzero(keys[at] == own))


def known_keys(lists: pa.Array, i: int, j: int) -> np.ndarray:
    """Sorted keys of `known_runs` for rows i to j of a column of anchor lists, as texts 0 to j - i."""
    part = lists.slice(i, j - i)
    flat = part.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    sizes = np.diff(part.offsets.to_numpy())
    return np.unique((np.repeat(np.arange(j - i), sizes).astype(U) << U(32)) | flat.astype(U))


def dealt_windows(runs: Runs, heavy: dict[int, int], window_hash: Callable[[np.ndarray], np.ndarray]) -> tuple[Runs, np.ndarray]:
    """Runs with their keys: the anchor, and for windows of heavy anchors, each a run by itself, the part too."""
    key = runs.anchor.astype(np.int64)
    if not heavy:
        return runs, key
    names = np.array(sorted(heavy), np.int64)
    at = np.minimum(np.searchsorted(names, key), len(names) - 1)
    parts = np.where(names[at] == key, np.array([heavy[n] for n in names.tolist()], np.int64)[at], 1)
    many = np.flatnonzero(parts > 1)
    if not len(many):
        return runs, key
    n = runs.count[many]
    start = np.repeat(runs.start[many] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    again = np.repeat(many, n)
    part = (window_hash(start) % parts[again].astype(U)).astype(np.int64)
    one = Runs(runs.doc[again], start, np.ones(len(start), np.int64), runs.anchor[again], runs.place[again])
    rest = np.flatnonzero(parts == 1)
    both = Runs(*(np.concatenate([x, y]) for x, y in zip(runs.take(rest).__dict__.values(), one.__dict__.values())))
    return both, np.concatenate([key[rest], key[again] | ((part + 1) << 32)])


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by document and start, with those that touch or overlap put together."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) * (int(end.max()) + 2)  # one line for all documents
    reach = np.maximum.accumulate(end + base)
    first = np.ones(len(doc), bool)
    first[1:] = start[1:] + base[1:] > reach[:-1]
    cut = np.flatnonzero(first)
    return doc[cut], start[cut], reach[np.append(cut[1:] - 1, len(doc) - 1)] - base[cut]


def span_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    """For each document its merged spans, as bytes of start and end pairs."""
    doc, start, end = merged_spans(doc, start, end)
    pairs = np.stack([start, end], axis=1).astype(np.int64).tobytes()
    first = _first_of(doc)
    return [(d, pairs[16 * a : 16 * b]) for d, a, b in zip(doc[first].tolist(), first.tolist(), [*first[1:].tolist(), len(doc)])]


def spans_of(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged starts and ends of row `k` of a column with spans of `spans_by_document`."""
    pairs = np.frombuffer(column[k].as_py() or b"", np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]
