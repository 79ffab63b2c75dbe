"""Removal of repeated word passages: seeds on winnowed anchors, extended both ways.

Anchors bring the places that may repeat to one shard, each with the words
around it. There a seed is extended word by word: places that share an anchor
fall into ever finer classes by the words to its left, and likewise by those to
its right. A window with `i` words left of its anchor repeats where another
place has the same left class of `i` and right class of the rest. Every covering
window is found so, which leaves the maximal repeats over the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthline.llm import anchors as A
from depthline.llm import kernels as K

U = np.uint64
#: 35-word windows, found by 8-word grams.
RULE = A.Rule(window=35, gram=8, distinct_docs=False)


def _word_grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of every `k` words, from one running polynomial over the block."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    at = np.arange(n)
    return (_run_hashes(hashes)(at, at + k) >> U(32)).astype(np.uint32)


def _split(rule: A.Rule) -> A.Split:
    def split(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, A.Runs, dict]]:
        for i, j in K.blocks(off):
            part, own = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            start, end, bounds = K.words(part, own)
            hashes = K.span_hash(part, start, end)
            yield i, j, A.runs_of(_word_grams(hashes, rule.gram), bounds, rule, placed=True), {"hashes": hashes, "bounds": bounds}

    return split


_ENTRY = pa.schema(
    [("shard", pa.int64()), *A.MAIL] + [(n, pa.binary()) for n in ("keys", "starts", "marks", "sizes", "times", "words")]
)
_ENTRY_SQL = f"shard bigint, {A.MAIL_SQL}, keys binary, starts binary, marks binary, sizes binary, times binary, words binary"


def _contexts(known: DataFrame, rule: A.Rule, heavy: dict[int, int], shards: int) -> DataFrame:
    """Entries of the runs of known anchors with the words around them, packed by shard, and mail with the spans that a batch settles itself.

    A passage that a batch holds twice is repeated for certain; it is sent once,
    as two times, so that other batches learn of it.
    """
    split = _split(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            buf, off = K.text_bytes(batch["text"])
            for i, j in K.blocks(off, rule.batch_bytes):
                parts, words, base = [], [], 0
                for a, b, runs, more in split(buf[off[i] : off[j]], off[i : j + 1] - off[i]):
                    runs = A.known_runs(runs, A.known_keys(batch["known"], i + a, i + b))
                    h = more["hashes"]
                    whole = _run_hashes(h)
                    runs, key = A.dealt_windows(runs, heavy, lambda s, w=whole: w(s, s + rule.window))
                    end = runs.start + runs.count + rule.window - 1
                    digest = whole(runs.start, end) ^ K.mix((runs.place - runs.start).astype(U))
                    parts.append((key, digest, runs.doc + i + a, runs.start - more["bounds"][runs.doc], runs.start + base, end + base, runs.place - runs.start))
                    words.append(h)
                    base += len(h)
                key, digest, row, local, start, end, mark = (np.concatenate(x) for x in zip(*parts))
                if not len(key):
                    continue
                words = np.concatenate(words)
                doc = ids[row]
                order = np.lexsort((digest, key))
                key, digest, doc, local, start, end, mark = (x[order] for x in (key, digest, doc, local, start, end, mark))
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(key)))
                twice = np.repeat(n > 1, n)
                settled = A.span_rows(doc[twice], local[twice], (local + end - start)[twice])
                out = [{"shard": r["bucket"], **r} for r in A.mailed(*A.mailed_spans(settled), shards)]
                shard = A._shard(key[first], shards)
                some = first[np.argsort(shard, kind="stable")]
                times = np.minimum(n, 2).astype(np.int8)[np.argsort(shard, kind="stable")]
                shard = np.sort(shard)
                cuts = np.append(A._first_of(shard), len(shard))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    own = some[a:b]
                    size = (end - start)[own]
                    at = np.repeat(start[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    out.append(
                        {
                            "shard": int(shard[a]),
                            "keys": key[own].tobytes(),
                            "docs": doc[own].tobytes(),
                            "starts": local[own].tobytes(),
                            "marks": mark[own].astype(np.int32).tobytes(),
                            "sizes": size.astype(np.int32).tobytes(),
                            "times": times[a:b].tobytes(),
                            "words": words[at].tobytes(),
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, _ENTRY)

    return known.mapInArrow(run, _ENTRY_SQL)


def _run_hashes(hashes: np.ndarray):
    """A function from starts and ends to hashes of the words between."""
    return K.running_hash(hashes >> U(33), hashes & U(2**31 - 1))


def _classes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Finer classes: equal where the class before and the next word are."""
    order = np.lexsort((word, before))
    new = np.zeros(len(order), np.int64)
    new[1:] = (before[order][1:] != before[order][:-1]) | (word[order][1:] != word[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _shard_spans(rows: list[dict], rule: A.Rule) -> Iterator[tuple[int, bytes]]:
    """Spans of the entries of a shard whose windows occur at two places or more."""
    key, doc, start = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("keys", "docs", "starts"))
    mark, size = (np.concatenate([np.frombuffer(r[c], np.int32) for r in rows]).astype(np.int64) for c in ("marks", "sizes"))
    times = np.concatenate([np.frombuffer(r["times"], np.int8) for r in rows]).astype(np.int64)
    words = np.concatenate([np.frombuffer(r["words"], U) for r in rows])
    at = np.cumsum(size) - size
    _, seed = np.unique(key, return_inverse=True)
    rest = rule.window - rule.gram  # words of a window outside its anchor
    left_room, right_room = mark, size - mark - rule.gram
    first_window, last_window = 0, size - rule.window  # starts of windows within an entry
    everyone = np.arange(len(key))

    def extended(room: np.ndarray, place) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each number of words, the entries with that room and their classes."""
        member, level = everyone, seed
        out = [(member, level)]
        for k in range(1, rest + 1):
            stays = room[member] >= k
            member, level = member[stays], level[stays]
            level = _classes(level, words[at[member] + place(member, k)])
            out.append((member, level))
        return out

    lefts = extended(left_room, lambda m, k: mark[m] - k)
    rights = extended(right_room, lambda m, k: mark[m] + rule.gram + k - 1)
    out_doc, out_start = [], []
    right_class = np.full(len(key), -1, np.int64)
    for i in range(rest + 1):
        member, left = lefts[i]
        begin = mark[member] - i
        good = (begin >= first_window) & (begin <= last_window[member])
        member, left, begin = member[good], left[good], begin[good]
        if not len(member):
            continue
        others, level = rights[rest - i]
        right_class[:] = -1
        right_class[others] = level
        both = _classes(left, right_class[member])
        repeated = np.bincount(both, times[member])[both] >= 2
        repeated &= times[member] == 1  # the others were settled where they came from
        out_doc.append(doc[member][repeated])
        out_start.append((start[member] + begin)[repeated])
    if out_doc:
        d, s = np.concatenate(out_doc), np.concatenate(out_start)
        yield from A.span_rows(d, s, s + rule.window)


def _spans(entries: DataFrame, rule: A.Rule, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found = [], []
        for batch in batches:
            mail = pa.compute.is_valid(batch["bucket"])
            found.append(A.mail_of(batch.filter(mail), 2))
            rows += batch.filter(pa.compute.invert(mail)).to_pylist()
        if rows:
            found.append(A.mailed_spans(list(_shard_spans(rows, rule))))
        if found:
            yield pa.RecordBatch.from_pylist(A.mailed(*(np.concatenate(x) for x in zip(*found)), buckets), pa.schema(A.MAIL))

    return A.dealt(entries, buckets).mapInArrow(run, A.MAIL_SQL)


def repeated_spans(docs: DataFrame, rule: A.Rule = RULE) -> DataFrame:
    """doc_id and spans (pairs of first and end word as bytes) of what repeats."""
    shards = A.shards_for(docs)
    shared = A.shared_anchors(docs, rule, _split(rule), shards)
    heavy = A.heavy_anchors(shared, rule)
    contexts = _contexts(A.known_texts(docs, shared), rule, heavy, shards)
    return A.spans_by_document(_spans(contexts, rule, shards))


def _kept_words(buf: np.ndarray, off: np.ndarray, lists: pa.Array, first_row: int) -> Iterator[tuple[int, int, bytes]]:
    """Words, removed words and the kept words joined by spaces, for each text of a block."""
    start, end, bounds = K.words(buf, off)
    gone = np.zeros(len(start) + 1, np.int64)
    for k in range(len(off) - 1):
        a, b = A.spans_of(lists, first_row + k)
        n = bounds[k + 1] - bounds[k]
        fits = b <= n
        np.add.at(gone, bounds[k] + a[fits], 1)
        np.add.at(gone, bounds[k] + b[fits], -1)
    kept = np.cumsum(gone[:-1]) == 0
    total = np.concatenate([[0], np.cumsum(kept)])
    some = np.flatnonzero(kept)
    text = np.repeat(np.arange(len(off) - 1), np.diff(bounds))[some]
    last = np.ones(len(some), bool)
    last[:-1] = text[1:] != text[:-1]
    size = end[some] - start[some] + ~last
    place = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(place[-1]) + np.repeat(start[some] - place[:-1], size)
    out = np.append(buf, np.uint8(0x20))[at]
    out[place[1:][~last] - 1] = 0x20
    ends = place[total[bounds]]
    for k in range(len(off) - 1):
        n = int(bounds[k + 1] - bounds[k])
        yield n, n - int(total[bounds[k + 1]] - total[bounds[k]]), out[ends[k] : ends[k + 1]].tobytes()


def without_repeats(docs: DataFrame, rule: A.Rule = RULE, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and `kept`, the remaining words joined by one space, of `docs(doc_id, text)`.

    With `digests`, `kept_sha256` in place of `kept`. A word goes if it lies in a
    window of `rule.window` words that also begins anywhere else, in the same
    document or another; all windows are judged on the input. Null texts have no
    words. A null doc_id is left as it is and repeats nothing. Rows that repeat a
    doc_id repeat each other. Other columns are not looked at.
    """
    plain = A.texts(docs)
    rows, nameless = plain.filter("doc_id is not null"), plain.filter("doc_id is null")
    joined = rows.join(repeated_spans(rows, rule), "doc_id", "left").select("doc_id", "text", "spans")
    last = "kept_sha256 string" if digests else "kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.text_bytes(batch["text"])
            n, removed, kept = [], [], []
            for i, j in K.blocks(off):
                for a, b, rest in _kept_words(buf[off[i] : off[j]], off[i : j + 1] - off[i], batch["spans"], i):
                    n.append(a)
                    removed.append(b)
                    kept.append(hashlib.sha256(rest).hexdigest() if digests else rest.decode())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", last.split(" ")[0]],
            )

    every = joined.unionByName(nameless.withColumn("spans", F.lit(None).cast("binary")))
    return every.mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, {last}")
