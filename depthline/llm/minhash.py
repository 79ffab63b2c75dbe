"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

Documents with the same set are one class from the start. The classes are cut
into buckets by bands of their signatures. Candidate pairs of a bucket are never
all emitted: first every member is held against the least member of its bucket;
what is still in different components is then held against the most similar
member of another component, and only pairs that even then lie in different
components are all checked. A link always rests on the full sets of both texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthline.llm import graph
from depthline.llm import kernels as K
from depthline.llm import signatures as S
from depthline.session import grows, materialise


@dataclass(frozen=True)
class Rule:
    """What a near duplicate is, and how it is searched.

    Two sets are linked when 100 * intersection >= `percent` * union. A pair at
    the threshold misses all of the `bands` bands of `rows` slots with
    probability (1 - t^rows)^bands: 2e-10 at 0.85, 5e-8 at 0.8. Before texts are
    read, pairs are dropped whose signatures agree in a share of slots that is
    `slack` below the threshold, six standard deviations of that estimate.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    slack: float = 0.2

    @property
    def slots(self) -> int:
        return self.bands * self.rows


def _block_shingles(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    buf = K.lower_ascii(buf)
    start, end, bounds = K.words(buf, off)
    return K.shingles(K.span_hash(buf, start, end), bounds, words)


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, two digests of the set and the signature (two bytes a slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.text_bytes(batch["text"])
            for i, j in K.blocks(off):
                elements, bounds = _block_shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], rule.words)
                size, one, two = S.set_digests(elements, bounds)
                slots = S.short_form(S.super_min_hash(elements, bounds, rule.slots))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(i, j - i),
                        pa.array(size),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.array([s.tobytes() for s in slots], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "one", "two", "signature"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, one bigint, two bigint, signature binary")


def _slots(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, n)


def _alike(pairs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that sizes and signatures don't rule out."""
    side = members.select("doc_id", F.col("n_shingles").alias("n"), F.col("signature").alias("s"))
    left = side.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = side.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = pairs.join(grows(left), "a").join(grows(right), "b")
    both = both.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * rule.percent)
    least = rule.percent / 100 - rule.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_slots(batch["sa"], rule.slots) == _slots(batch["sb"], rule.slots)).mean(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                sets = [_block_shingles(*K.text_bytes(part[c]), rule.words) for c in ("ta", "tb")]
                linked = []
                for k in range(part.num_rows):
                    x, y = (np.unique(e[o[k] : o[k + 1]]) for e, o in sets)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(shared > 0 and 100 * shared >= rule.percent * (len(x) + len(y) - shared))
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.join(grows(left), "a").join(grows(right), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal `key` from batches that come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[key].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if held and held[-1][key][0].as_py() != part[key][0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _across(buckets: DataFrame, rule: Rule, best_only: bool) -> DataFrame:
    """Pairs of one bucket that lie in different components and may be similar, as lists a and b of a tile.

    A pair comes from the first band that both share, so once at most. With
    `best_only` each member gives its most similar partner alone. Buckets are
    worked through in tiles of 256 x 256.
    """
    least = rule.percent / 100 - rule.slack
    ratio = rule.percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "bucket"):
            bucket, band = group["bucket"][0].as_py(), group["band"][0].as_py()
            ids, labels, sizes = (group[c].to_numpy() for c in ("doc_id", "label", "n_shingles"))
            slots = _slots(group["signature"].combine_chunks(), rule.slots)
            codes = np.zeros((len(ids), band), np.uint64)  # of the bands before this one
            for k in range(rule.rows):
                codes = K.mix(codes + slots[:, k : band * rule.rows : rule.rows] + np.uint64(1))
            n = len(ids)
            for i in range(0, n, 256):
                top = np.full(min(256, n - i), -1.0)
                partner = np.zeros(len(top), np.int64)
                for j in range(0 if best_only else i, n, 256):
                    x, y = slice(i, i + 256), slice(j, j + 256)
                    ok = labels[x][:, None] != labels[y][None, :]
                    ok &= np.minimum(sizes[x][:, None], sizes[y][None, :]) >= ratio * np.maximum(sizes[x][:, None], sizes[y][None, :])
                    p, q = np.nonzero(ok)
                    if not best_only:
                        upper = p + i < q + j
                        p, q = p[upper], q[upper]
                    for k in range(band):  # most pairs that share an earlier band go at the first few
                        apart = codes[p + i, k] != codes[q + j, k]
                        p, q = p[apart], q[apart]
                    left, right = [], []
                    for cut in range(0, len(p), 16_384):
                        pc, qc = p[cut : cut + 16_384], q[cut : cut + 16_384]
                        same = (slots[pc + i] == slots[qc + j]).mean(axis=1)
                        pc, qc, same = (v[same >= least] for v in (pc, qc, same))
                        if best_only:
                            order = np.lexsort((-qc, same))  # the last of a member is its best
                            better = order[same[order] > top[pc[order]]]
                            top[pc[better]], partner[pc[better]] = same[better], ids[qc[better] + j]
                            continue
                        left.append(ids[pc + i])
                        right.append(ids[qc + j])
                    if left and sum(map(len, left)):
                        yield _tile(f"{bucket}/{i}/{j}", np.concatenate(left), np.concatenate(right))
                own = np.flatnonzero(top >= 0)
                if len(own):
                    yield _tile(f"{bucket}/{i}", ids[own + i], partner[own])

    spread = buckets.repartition("bucket").sortWithinPartitions("bucket")
    return spread.mapInArrow(run, "tile string, a array<bigint>, b array<bigint>")


def _tile(name: str, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    lists = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([a], lists), pa.array([b], lists)], ["tile", "a", "b"])


def _verified_tiles(tiles: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Links among the pairs of each tile, without those whose ends earlier links of the tile join.

    A text comes once to a tile, however many pairs it is in.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    members = tiles.select("tile", F.explode(F.array_distinct(F.concat("a", "b"))).alias("doc_id")).join(grows(texts), "doc_id")
    empty = F.lit(None).cast("array<bigint>")
    rows = members.select("tile", "doc_id", "text", empty.alias("a"), empty.alias("b")).unionByName(
        tiles.select("tile", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), "a", "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "tile"):
            named = group.filter(pa.compute.is_valid(group["doc_id"]))
            pairs = group.filter(pa.compute.is_null(group["doc_id"]))
            sets: dict[int, np.ndarray] = {}
            ids = named["doc_id"].to_pylist()
            buf, off = K.text_bytes(named["text"])
            for i, j in K.blocks(off):
                elements, bounds = _block_shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], rule.words)
                for k in range(j - i):
                    sets[ids[i + k]] = np.unique(elements[bounds[k] : bounds[k + 1]])
            root = {d: d for d in sets}
            links = []
            for x, y in zip(pairs["a"].combine_chunks().flatten().to_pylist(), pairs["b"].combine_chunks().flatten().to_pylist()):
                if _root(root, x) == _root(root, y):
                    continue
                shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if shared and 100 * shared >= rule.percent * (len(sets[x]) + len(sets[y]) - shared):
                    root[_root(root, x)] = _root(root, y)
                    links.append((min(x, y), max(x, y)))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*links)], ["a", "b"])

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a bigint, b bigint")


def _root(root: dict[int, int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def near_duplicates(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept for each row of `docs(doc_id, text)`.

    `class_id` is the least doc_id with the same set, `component_id` the least
    doc_id that links reach. Null, empty and wordless texts have no shingles and
    are linked with nothing. Rows that repeat a doc_id come back as often; they
    are one node. A null doc_id is linked with nothing and has null results.
    Other columns are not looked at.
    """
    rule = rule or Rule()
    every = materialise(sketches(docs, rule), "sketches")
    known = every.filter("doc_id is not null and n_shingles > 0")
    key = ["n_shingles", "one", "two"]
    classes = known.groupBy(*key).agg(F.min("doc_id").alias("class_id"))
    member = known.join(grows(classes), key)
    copies = materialise(member.filter("doc_id <> class_id").select("doc_id", "class_id").distinct(), "copies")
    first = materialise(
        member.filter("doc_id = class_id").dropDuplicates(["doc_id", *key]).select("doc_id", "n_shingles", "signature"), "first"
    )
    width = 2 * rule.rows
    bands = first.select(
        "doc_id",
        F.posexplode(F.array(*[F.xxhash64(F.substring("signature", i * width + 1, width), F.lit(i)) for i in range(rule.bands)])).alias(
            "band", "bucket"
        ),
    )
    heads = bands.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = bands.join(grows(heads), "bucket").filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    links = materialise(_verified(_alike(stars, first, rule), docs, rule), "links")
    crowded = materialise(bands.join(grows(heads), "bucket").select("bucket", "band", "doc_id"), "buckets")
    for best_only in (True, False):
        label = graph.components(links)
        labelled = crowded.join(grows(label.withColumnRenamed("node", "doc_id")), "doc_id", "left").withColumn(
            "label", F.coalesce("component", "doc_id")
        )
        open_ = labelled.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l <> m")
        members = labelled.join(grows(open_.select("bucket")), "bucket", "left_semi").select("bucket", "band", "doc_id", "label")
        tiles = materialise(_across(members.join(grows(first), "doc_id"), rule, best_only), "tiles")
        more = materialise(_verified_tiles(tiles, docs, rule), "links")
        links = links.unionByName(more)
    label = graph.components(links).select(F.col("node").alias("class_id"), "component")
    return (
        every.select("doc_id", "n_shingles")
        .join(grows(copies), "doc_id", "left")
        .withColumn("class_id", F.coalesce("class_id", "doc_id"))
        .join(grows(label), "class_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            "class_id",
            F.coalesce("component", "class_id").alias("component_id"),
            (F.col("doc_id") == F.coalesce("component", "class_id")).alias("kept"),
        )
    )
