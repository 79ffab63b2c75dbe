"""Connected components of link tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthline.session import materialise


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of each batch: every node with the least node of its tree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.concatenate([batch["a"].to_numpy(), batch["b"].to_numpy()])
        nodes, place = np.unique(ends, return_inverse=True)
        half = batch.num_rows
        root = list(range(len(nodes)))
        for x, y in zip(place[:half].tolist(), place[half:].tolist()):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
        for x in range(len(root)):
            root[x] = root[root[x]]  # parents are smaller and already settled
        found = np.array(root)
        far = found != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[found[far]]), pa.array(nodes[far])], ["a", "b"])


def _settled(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
    return row[0], row[1] or 0


def components(links: DataFrame) -> DataFrame:
    """`node` and `component`, the least node it can reach, for each node of `links(a, b)`.

    Union-find inside the batches of each partition first leaves a forest; then
    every node hands its larger neighbours, and next its smaller ones, to the
    least node that it knows, until nothing changes (large-star and small-star).
    The links of each round are written to the shared folder. Links with a null
    end and links of a node with itself are left out; repeated links count once.
    """
    plain = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    plain = plain.filter("a is not null and b is not null and a < b")
    now = materialise(plain.mapInArrow(_forest, "a bigint, b bigint"), "links")
    seen = _settled(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        larger = (
            now.join(least, now["a"] == least["u"])
            .select(F.col("m").alias("a"), "b")
            .filter("a < b")
            .distinct()
        )
        # Each node's smaller neighbours, and itself, go to the least of them.
        under = larger.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        smaller = (
            larger.join(under, larger["b"] == under["u"])
            .select("m", F.explode(F.array("a", "b")).alias("b"))
            .filter("m < b")
            .select(F.col("m").alias("a"), "b")
            .distinct()
        )
        now = materialise(smaller, "links")
        count = _settled(now)
        if count == seen:
            break
        seen = count
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
