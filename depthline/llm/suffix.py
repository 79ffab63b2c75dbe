"""Removal of long byte strings that an earlier document holds too, by suffix arrays.

Windows come together in shards by their anchors. A shard strings the different
contents of its runs together, sorts all suffixes by induced sorting, and reads
from the permuted common prefixes which windows are equal; a window goes if the
least document that holds it is smaller than its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthline.llm import anchors as A
from depthline.llm import kernels as K
from depthline.llm import sais

U = np.uint64
#: 50-byte windows, found by 16-byte grams.
RULE = A.Rule(window=50, gram=16, distinct_docs=True)
#: Bytes of content that one suffix array takes; an anchor with more has its runs cut by longer grams.
ARRAY_BYTES = 1_000_000
#: Bytes of content of a shard whose windows are looked at together; an anchor's contents always are.
PART_BYTES = 8_000_000
#: Windows of a cut run, so that pieces of periodic stretches are equal; and windows compared at once.
PIECE, AT_ONCE = 500, 1_000_000


def byte_grams(buf: np.ndarray) -> np.ndarray:
    """32-bit hashes of the 16 bytes from each place on; places near the end have none."""
    n = len(buf) - 15
    if n <= 0:
        return np.zeros(0, np.uint32)
    words = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=np.ascontiguousarray(buf), strides=(1,))
    h = words[:n] * U(0x9E3779B97F4A7C15)
    h += words[8 : 8 + n] * U(0xC2B2AE3D27D4EB4F)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    return (h >> U(32)).astype(np.uint32)


def _long_grams(buf: np.ndarray, size: int) -> np.ndarray:
    """32-bit hashes of the `size` bytes from each place on, a multiple of 16."""
    half = byte_grams(buf).astype(U)
    n = max(0, len(buf) - size + 1)
    out = np.zeros(n, U)
    for k in range(0, size, 16):
        out = K.mix(out ^ half[k : k + n])
    return (out >> U(32)).astype(np.uint32)


def _split(rule: A.Rule) -> A.Split:
    def split(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, A.Runs, dict]]:
        for i, j in K.blocks(off):
            part, own = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            yield i, j, A.runs_of(byte_grams(part), own, rule, placed=False), {"buf": part, "off": own}

    return split


_ENTRY = pa.schema(
    [
        ("shard", pa.int64()),
        *A.MAIL,
        ("keys", pa.binary()),
        ("starts", pa.binary()),
        ("sizes", pa.binary()),
        ("content", pa.binary()),
    ]
)
_ENTRY_SQL = f"shard bigint, {A.MAIL_SQL}, keys binary, starts binary, sizes binary, content binary"


def _segments(known: DataFrame, rule: A.Rule, heavy: dict[int, int], shards: int) -> DataFrame:
    """Entries of the runs of known anchors, packed by shard, and mail with the spans that a batch settles itself."""
    split = _split(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            buf, off = K.text_bytes(batch["text"])
            for i, j in K.blocks(off, rule.batch_bytes):
                parts = []
                for a, b, runs, more in split(buf[off[i] : off[j]], off[i : j + 1] - off[i]):
                    runs = A.known_runs(runs, A.known_keys(batch["known"], i + a, i + b))
                    data, base = more["buf"], off[i + a]
                    runs, key = A.dealt_windows(runs, heavy, lambda s, d=data: K.span_hash(d, s, s + rule.window))
                    end = runs.start + runs.count + rule.window - 1
                    parts.append((key, K.span_hash(data, runs.start, end), runs.doc + i + a, runs.start + base, end + base))
                key, digest, row, start, end = (np.concatenate(x) for x in zip(*parts))
                if not len(key):
                    continue
                doc, local = ids[row], start - off[row]
                order = np.lexsort((doc, digest, key))
                key, digest, doc, local, start, end = (x[order] for x in (key, digest, doc, local, start, end))
                same = np.zeros(len(key), bool)
                same[1:] = (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])
                first = np.flatnonzero(~same)
                least = np.repeat(doc[first], np.diff(np.append(first, len(key))))
                later = doc > least  # a smaller document of this batch has all of the run
                settled = A.span_rows(doc[later], local[later], (local + end - start)[later])
                out = [{"shard": r["bucket"], **r} for r in A.mailed(*A.mailed_spans(settled), shards)]
                some = np.flatnonzero(~later)
                shard = A._shard(key[some], shards)
                some = some[np.argsort(shard, kind="stable")]
                shard = np.sort(shard)
                cuts = np.append(A._first_of(shard), len(shard)) if len(shard) else [0]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    own = some[a:b]
                    out.append(
                        {
                            "shard": int(shard[a]),
                            "keys": key[own].tobytes(),
                            "docs": doc[own].tobytes(),
                            "starts": local[own].tobytes(),
                            "sizes": (end - start)[own].astype(np.int32).tobytes(),
                            "content": packer.compress(b"".join(buf[s:e].tobytes() for s, e in zip(start[own].tolist(), end[own].tolist()))),
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, _ENTRY)

    return known.mapInArrow(run, _ENTRY_SQL)


def _least_docs(content: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """At each place of `content`, the least of `docs` that holds the window which begins there.

    `docs[k]` is the least document of the k-th content, which lies at
    `starts[k]`. Contents are separated by a value of its own, so no window
    crosses from one to the next.
    """
    n = len(sizes)
    text = np.zeros(len(content) + n, np.uint16)
    places = np.arange(len(content)) + np.repeat(np.arange(n), sizes)
    text[places] = content.astype(np.uint16) + 1
    owner = np.repeat(docs, sizes + 1)
    sa = sais.suffix_array(text, 257)
    shared = sais.permuted_lcp(text, sa)[sa]
    first = np.flatnonzero(shared < window)  # the first suffix shares nothing with one before it
    least = np.minimum.reduceat(owner[sa], first)
    out = np.empty(len(text), np.int64)
    out[sa] = np.repeat(least, np.diff(np.append(first, len(sa))))
    return out[places]


def _finer_runs(content: np.ndarray, start: np.ndarray, size: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, A.Runs]]:
    """For blocks of contents, their numbers and their runs by anchors of `gram` bytes; starts count from the content's."""
    ends = np.concatenate([[0], np.cumsum(size)])
    for i, j in K.blocks(ends):
        at = np.arange(ends[j] - ends[i]) + np.repeat(start[i:j] - (ends[i:j] - ends[i]), size[i:j])
        own = ends[i : j + 1] - ends[i]
        runs = A.runs_of(_long_grams(content[at], gram), own, A.Rule(window=window, gram=gram, distinct_docs=True), placed=False)
        runs.start -= own[runs.doc]
        yield np.arange(i, j)[runs.doc], runs


def _may_share(
    content: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, wanted: np.ndarray, window: int, gram: int = 32
) -> np.ndarray:
    """Which of the `wanted` contents share an anchor of `gram` bytes with another one of their group.

    Equal windows have equal anchors, so a content without a shared one has no
    window in common with any other and needs no place in a suffix array.
    """
    some = np.flatnonzero(wanted)
    if gram > window or not len(some):
        return wanted.copy()
    out = np.zeros(len(start), bool)
    keys, owners = [], []
    for of, runs in _finer_runs(content, start[some], size[some], window, gram):
        keys.append(K.mix(runs.anchor.astype(U) | (group[some[of]].astype(U) << U(32))))
        owners.append(some[of])
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = A._first_of(key)
    mixed = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
    out[owner[np.repeat(mixed, np.diff(np.append(first, len(key))))]] = True
    return out


def _parts(rows: list[dict], part_bytes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys, documents, starts, sizes and content of a shard's entries, in parts by key; takes the rows away."""
    unpacker = zstandard.ZstdDecompressor()
    total = sum(int(np.frombuffer(r["sizes"], np.int32).sum()) for r in rows)
    n = max(1, -(-total // part_bytes))
    parts: list[list[tuple]] = [[] for _ in range(n)]
    while rows:
        row = rows.pop()
        key, doc, start = (np.frombuffer(row[c], np.int64) for c in ("keys", "docs", "starts"))
        size = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        content = np.frombuffer(unpacker.decompress(row["content"]), np.uint8)
        part = (K.mix(key.astype(U) ^ U(0xA5A5A5A5A5A5A5A5)) % U(n)).astype(np.int64)
        byte_part = np.repeat(part, size)
        for p in np.unique(part).tolist():
            own = part == p
            parts[p].append((key[own], doc[own], start[own], size[own], content[byte_part == p]))
    while parts:
        found = parts.pop()
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))


def _shard_spans(rows: list[dict], window: int, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, bytes]]:
    """Spans of the entries of a shard whose windows a smaller document has; takes the rows away."""
    for part in _parts(rows, part_bytes):
        yield from _part_spans(*part, window)


def _part_spans(
    key: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, content: np.ndarray, window: int, gram: int = RULE.gram
) -> Iterator[tuple[int, bytes]]:
    """Spans of a part whose keys stand for anchors of `gram` bytes."""
    at = np.concatenate([[0], np.cumsum(size)])
    digest = np.concatenate([K.span_hash(content[at[a] : at[b]], at[a:b] - at[a], at[a + 1 : b + 1] - at[a]) for a, b in K.blocks(at)])
    order = np.lexsort((doc, digest, key))
    key_, digest_ = key[order], digest[order]
    new = np.ones(len(order), bool)
    new[1:] = (key_[1:] != key_[:-1]) | (digest_[1:] != digest_[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order)))  # entries of each different content
    own_key, own_doc, own_size, own_at = key_[first], doc[order][first], size[order][first], at[:-1][order][first]
    groups = np.append(A._first_of(own_key), len(own_key))
    alone = np.repeat(np.diff(groups) == 1, np.diff(groups))
    near = _may_share(content, own_at, own_size, np.repeat(np.arange(len(groups) - 1), np.diff(groups)), ~alone, window, gram + 16)
    # A content that shares no window with another one: its own least document has them all.
    full = order[np.repeat(~near, times) & (np.repeat(own_doc, times) < doc[order])]
    out = [(doc[full], start[full], start[full] + size[full])]
    batch: list[int] = []
    total = 0

    def entries_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of some contents, and which of `some` each one has."""
        n = times[some]
        return order[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.repeat(np.arange(len(some)), n)

    def solve() -> None:
        some = np.array(batch)
        text = np.concatenate([content[own_at[k] : own_at[k] + own_size[k]] for k in batch])
        place = np.cumsum(own_size[some]) - own_size[some]
        least = _least_docs(text, place, own_size[some], own_doc[some], window)
        mine, of = entries_of(some)
        lens = size[mine] - window + 1
        upto = np.concatenate([[0], np.cumsum(lens)])
        for i, j in K.blocks(upto, AT_ONCE):
            entry = np.repeat(np.arange(i, j), lens[i:j])
            off = np.arange(len(entry)) - (upto[entry] - upto[i])
            hit = least[place[of[entry]] + off] < doc[mine[entry]]
            entry, off = mine[entry[hit]], off[hit]
            out.append(A.merged_spans(doc[entry], start[entry] + off, start[entry] + off + window))

    large = []
    for a, b in zip(groups[:-1].tolist(), groups[1:].tolist()):
        if b - a == 1:
            continue
        some = a + np.flatnonzero(near[a:b])
        more = int(own_size[some].sum())
        if more > ARRAY_BYTES and gram + 16 <= window:
            large.append(some)
            continue
        batch += some.tolist()
        total += more
        if total >= ARRAY_BYTES:
            solve()
            batch, total = [], 0
    if batch:
        solve()
    yield from A.span_rows(*(np.concatenate(x) for x in zip(*out)))
    for some in large:
        mine, of = entries_of(some)
        for part in _finer_parts(content, own_at[some], own_size[some], own_key[some], mine, of, window, gram + 16):
            entry, off, length, finer, begin = part
            ends = np.cumsum(length)
            text = content[np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)]
            yield from _part_spans(finer, doc[entry], start[entry] + off, length, text, window, gram + 16)


def _finer_parts(
    content: np.ndarray, at: np.ndarray, size: np.ndarray, key: np.ndarray, entry: np.ndarray, of: np.ndarray, window: int, gram: int
) -> Iterator[tuple[np.ndarray, ...]]:
    """The contents' runs by anchors of `gram` bytes, in pieces, for every entry, in parts by the finer key.

    A window's anchor is that of its bytes, so equal windows meet again. Entry
    `entry[i]` has content `of[i]`. Gives entries, starts in the entry, sizes, keys
    and places in `content`.
    """
    owners, starts, counts, keys = [], [], [], []
    for own, runs in _finer_runs(content, at, size, window, gram):
        n = -(-runs.count // PIECE)
        piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owners.append(np.repeat(own, n))
        starts.append(np.repeat(runs.start, n) + piece * PIECE)
        counts.append(np.minimum(np.repeat(runs.count, n) - piece * PIECE, PIECE))
        keys.append(np.repeat(K.mix(runs.anchor.astype(U) ^ K.mix(key[own].astype(U))).astype(np.int64), n))
    owner, begin, count, finer = (np.concatenate(x) for x in (owners, starts, counts, keys))
    upto = np.searchsorted(owner, np.arange(len(at) + 1))  # blocks keep the contents' order
    times = np.bincount(of, minlength=len(at))
    length = count + window - 1
    n = max(1, -(-int((length * times[owner]).sum()) // PART_BYTES))
    part = (K.mix(finer.astype(U)) % U(n)).astype(np.int64)
    for p in range(n):
        run = np.flatnonzero(part == p)
        if not len(run):
            continue
        cut = np.searchsorted(run, upto)
        each = np.diff(cut)[of]
        k = run[np.repeat(cut[of] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        yield np.repeat(entry, each), begin[k], length[k], finer[k], at[owner[k]] + begin[k]


def _spans(entries: DataFrame, rule: A.Rule, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        found = []
        for batch in batches:
            mail = pa.compute.is_valid(batch["bucket"])
            found.append(A.mail_of(batch.filter(mail), 2))
            for i in np.flatnonzero(~mail.to_numpy(zero_copy_only=False)).tolist():  # views, not copies
                rows.append({c: batch[c][i].as_buffer() for c in ("keys", "docs", "starts", "sizes", "content")})
        if rows:
            found.append(A.mailed_spans(list(_shard_spans(rows, rule.window))))
        if found:
            yield pa.RecordBatch.from_pylist(A.mailed(*(np.concatenate(x) for x in zip(*found)), buckets), pa.schema(A.MAIL))

    return A.dealt(entries, buckets).mapInArrow(run, A.MAIL_SQL)


def repeated_spans(docs: DataFrame, rule: A.Rule = RULE) -> DataFrame:
    """doc_id and spans (pairs of start and end as bytes) of what earlier documents hold."""
    shards = A.shards_for(docs)
    shared = A.shared_anchors(docs, rule, _split(rule), shards)
    heavy = A.heavy_anchors(shared, rule)
    segments = _segments(A.known_texts(docs, shared), rule, heavy, shards)
    return A.spans_by_document(_spans(segments, rule, shards))


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    plain = A.texts(docs)
    return plain.filter("doc_id is not null"), plain.filter("doc_id is null")


def without_repeats(docs: DataFrame, rule: A.Rule = RULE, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and `kept`, the remaining bytes of each text of `docs(doc_id, text)`.

    With `digests`, `kept_sha256` in place of `kept`. A byte goes if it lies in
    a window of `rule.window` bytes that also begins in a document with a smaller
    doc_id; all windows are judged on the input. Null texts are empty. A null
    doc_id is nobody's earlier document and loses nothing. Rows that repeat a
    doc_id lose the spans that any of them loses, so they should have one text.
    Other columns are not looked at.
    """
    rows, nameless = _prepared(docs)
    joined = rows.join(repeated_spans(rows, rule), "doc_id", "left").select("doc_id", "text", "spans")
    last = "kept_sha256 string" if digests else "kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.text_bytes(batch["text"])
            removed, n_spans, kept = [], [], []
            for k in range(batch.num_rows):
                text = buf[off[k] : off[k + 1]]
                start, end = A.spans_of(batch["spans"], k)
                start, end = start[end <= len(text)], end[end <= len(text)]
                gone = (end - start).sum() if len(start) else 0
                if gone:
                    cuts = np.stack([np.append(0, end), np.append(start, len(text))], axis=1).tolist()
                    rest = b"".join(text[a:b].tobytes() for a, b in cuts)
                else:
                    rest = text.tobytes()
                removed.append(int(gone))
                n_spans.append(len(start))
                kept.append(hashlib.sha256(rest).hexdigest() if digests else rest)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(np.diff(off)),
                    pa.array(removed, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array(kept, pa.string() if digests else pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", last.split(" ")[0]],
            )

    every = joined.unionByName(nameless.withColumn("spans", F.lit(None).cast("binary")))
    return every.mapInArrow(run, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last}")
