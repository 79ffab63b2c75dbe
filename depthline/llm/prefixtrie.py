"""The prefix tree of conversations, from z-fast tries that Spark merges.

Every prefix of a conversation has a key, so that prefixes are equal where their
keys are. Conversations are inserted batch by batch into compacted tries whose
nodes are hashed at their handle: the prefix at the two-fattest depth of the
node's edge. A fat binary search over a conversation's keys finds the node where
it leaves the trie in about log2(depth) lookups. The edges of each batch's trie
are then expanded to one row a prefix, and Spark adds up the rows of all
batches. Sums over subtrees need no walk: each node belongs to its least member,
what a conversation owns is the end of its path, and it counts once for every
prefix on the rest of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthline.operators import ordered
from depthline.session import materialise

KEY_BYTES = 16
#: Turns that one row holds; longer conversations are rows one after the other.
SEGMENT = 1024
#: Turns of a trie; a batch of rows with more is cut.
TRIE_TURNS = 200_000
#: Ids that are joined to one text at a time.
ID_BLOCK = 65_536
ROOT = bytes(KEY_BYTES)
_SPACE = "[\\x20\\x09-\\x0D]+"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """`conv_id`, `at` (0-based place), `digest` and `n_words` of every turn.

    Turns are in the order of `turn`, null first, and of their digest where that
    is the same; a null role or text is empty. Rows with a null conv_id belong to
    no conversation and are left out. A conversation of any length is ordered in
    blocks of turns. The table is written once.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.size(F.array_remove(F.split(text, _SPACE), "")).cast("bigint").alias("n_words"),
    )
    block = F.floor(F.col("turn") / SEGMENT)
    placed = ordered.dense_index(rows, ["conv_id"], ["turn", "digest"], block, "at").drop("turn")
    return materialise(placed, "turns")  # read for counts, for heads and for all turns


def paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: `(conv_id, depth, digest, n_words, total)` of all turns, and `(conv_id, total)`."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    own = turns.join(convs, "conv_id").select("conv_id", (F.col("at") + 1).alias("depth"), "digest", "n_words", "total")
    return own, convs


def shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """As `paths`, each conversation c with its first h turns from conversation c - c % `every`.

    h is the checksum of the decimal c, modulo `most`; the lender gives what it
    has, and c's own turns go on after its first h.
    """
    c = F.col("conv_id")
    n = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    borrowed = F.crc32(c.cast("string").cast("binary")) % most
    convs = n.select("conv_id", "n", borrowed.alias("h"), (c - c % every).alias("lender"))
    lenders = n.filter(c % every == 0).select(c.alias("lender"), F.col("n").alias("held"))
    convs = convs.join(lenders, "lender", "left").withColumn("lent", F.least("h", F.coalesce("held", F.lit(0))))
    total = F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = convs.select("conv_id", "lender", "h", "lent", total.alias("total"))
    heads = turns.filter((c % every == 0) & (F.col("at") < most - 1)).withColumnRenamed("conv_id", "lender")
    columns = ["conv_id", "depth", "digest", "n_words", "total"]
    own = turns.join(convs, "conv_id").filter("at >= h").withColumn("depth", F.col("at") - F.col("h") + F.col("lent") + 1)
    lent = convs.join(heads, "lender").filter("at < h").withColumn("depth", F.col("at") + 1)
    return own.select(columns).unionByName(lent.select(columns)), convs.select("conv_id", "total")


def _segments(rows: DataFrame, size: int) -> DataFrame:
    """A written table with the keys of all prefixes, up to `size` turns in a row.

    Inside a segment each key is a digest of the key before it and the turn. The
    key at a segment's end comes from the sum of the digests of all segments up
    to there, so that segments of one conversation are worked on apart.
    """
    parts = rows.groupBy("conv_id", F.floor((F.col("depth") - 1) / size).alias("segment"), "total").agg(
        F.sort_array(F.collect_list(F.struct("depth", "digest", "n_words"))).alias("turns")
    )
    hexed = F.array_join(F.transform("turns.digest", F.hex), "")
    named = F.sha2(F.concat(F.col("segment").cast("string"), F.lit(":"), hexed), 256)
    full = parts.filter(F.size("turns") == size).select("conv_id", "segment", named.alias("name"))
    so_far = Window.partitionBy("conv_id").orderBy("segment")  # one short row for each full segment
    lanes = [
        F.sum(F.conv(F.substring("name", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).over(so_far) for k in range(4)
    ]
    summed = F.sha2(F.concat_ws(":", "segment", *[s.cast("string") for s in lanes]), 256)
    ends = full.select("conv_id", "segment", F.unhex(F.substring(summed, 1, 2 * KEY_BYTES)).alias("key"))
    starts = ends.select("conv_id", (F.col("segment") + 1).alias("segment"), F.col("key").alias("start"))
    keyed = parts.join(starts, ["conv_id", "segment"], "left").join(
        ends.withColumnRenamed("key", "stop"), ["conv_id", "segment"], "left"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words, bases = [], [], []
            for start, stop, turns in zip(batch["start"].to_pylist(), batch["stop"].to_pylist(), batch["turns"]):
                turns = turns.values
                key = bases_key = start or ROOT
                chain = []
                for digest in turns.field("digest").to_pylist():
                    key = hashlib.sha256(key + digest).digest()[:KEY_BYTES]
                    chain.append(key)
                if stop is not None:
                    chain[-1] = stop
                keys.append(b"".join(chain))
                words.append(turns.field("n_words").to_pylist())
                bases.append(bases_key)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["conv_id"],
                    pc.multiply(batch["segment"], size),
                    batch["total"],
                    pa.array(bases, pa.binary()),
                    pa.array(keys, pa.binary()),
                    pa.array(words, pa.list_(pa.int64())),
                ],
                ["conv_id", "base", "total", "start", "keys", "words"],
            )

    kinds = dict(parts.dtypes)
    schema = f"conv_id {kinds['conv_id']}, base bigint, total bigint, start binary, keys binary, words array<bigint>"
    return materialise(keyed.select("conv_id", "segment", "total", "start", "stop", "turns").mapInArrow(run, schema), "segments")


def two_fattest(a: int, b: int) -> int:
    """The multiple of the highest power of two in (a, b]."""
    bit = (a ^ b).bit_length() - 1
    return b >> bit << bit


class Node:
    """An edge of the compacted trie, from depth `lo` (not included) to `hi`, as in segment `ref`."""

    __slots__ = ("lo", "hi", "ref", "parent", "children", "count", "least")

    def __init__(self, lo: int, hi: int, ref: int, parent: Node | None):
        self.lo, self.hi, self.ref, self.parent = lo, hi, ref, parent
        self.children: dict[bytes, Node] = {}
        self.count, self.least = 0, None


class ZFastTrie:
    """A compacted trie of keyed paths; `handles` has each node at its two-fattest depth.

    Paths are rows of keys, from a start (`base` deep) on. Paths with the same
    start lie under the same root.
    """

    def __init__(self):
        self.paths: list[tuple[int, bytes]] = []
        self.roots: dict[bytes, Node] = {}
        self.handles: dict[bytes, Node] = {}
        self.nodes: list[Node] = []

    def key(self, ref: int, depth: int) -> bytes:
        base, keys = self.paths[ref]
        at = (depth - base - 1) * KEY_BYTES
        return keys[at : at + KEY_BYTES]

    def exit_node(self, ref: int, root: Node, end: int) -> Node:
        """The deepest node whose whole path begins the given one, by fat binary search."""
        node, a, b = root, root.hi, end
        while a < b:
            f = two_fattest(a, b)
            met = self.handles.get(self.key(ref, f))
            if met is not None and met.hi <= end and self.key(met.ref, met.hi) == self.key(ref, met.hi):
                node, a = met, met.hi
            else:
                b = f - 1
        return node

    def _hang(self, node: Node) -> None:
        self.handles[self.key(node.ref, two_fattest(node.lo, node.hi))] = node
        node.parent.children[self.key(node.ref, node.lo + 1)] = node

    def _shared(self, ref: int, other: Node, end: int) -> int:
        """The depth down to which a path runs along another node's edge."""
        low, high = other.lo + 1, min(other.hi, end)
        while low < high:
            middle = (low + high + 1) // 2
            if self.key(ref, middle) == self.key(other.ref, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def insert(self, member: int, start: bytes, base: int, keys: bytes) -> None:
        ref, end = len(self.paths), base + len(keys) // KEY_BYTES
        self.paths.append((base, keys))
        root = self.roots.get(start)
        if root is None:
            root = self.roots[start] = Node(base, base, ref, None)
        node = self.exit_node(ref, root, end)
        if node.hi < end:
            below = node.children.get(self.key(ref, node.hi + 1))
            if below is not None:  # leaves inside an edge, which is split
                split = self._shared(ref, below, end)
                middle = Node(below.lo, split, below.ref, node)
                del self.handles[self.key(below.ref, two_fattest(below.lo, below.hi))]
                below.lo, below.parent = split, middle
                self._hang(middle)
                self._hang(below)
                self.nodes.append(middle)
                node = middle
            if node.hi < end:
                leaf = Node(node.hi, end, ref, node)
                self._hang(leaf)
                self.nodes.append(leaf)
                node = leaf
        node.count += 1
        node.least = member if node.least is None else min(node.least, member)

    def settled(self) -> list[Node]:
        """All nodes but the roots, with the members of their whole subtrees."""
        for node in sorted(self.nodes, key=lambda n: -n.hi):
            above = node.parent
            if above.parent is not None or above.lo < above.hi:
                above.count += node.count
                above.least = node.least if above.least is None else min(above.least, node.least)
        return self.nodes


def _expanded(segments: DataFrame) -> DataFrame:
    """A row for each prefix and batch: its key, its parent's, depth, words of its last turn, members and the least."""
    kind = dict(segments.dtypes)["conv_id"]

    def rows_of(trie: ZFastTrie, starts: list[bytes], words: list[list[int]]) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for node in trie.settled():
            base, _ = trie.paths[node.ref]
            for depth in range(node.lo + 1, node.hi + 1):
                above = trie.key(node.ref, depth - 1) if depth - 1 > base else starts[node.ref]
                row = (trie.key(node.ref, depth), above, depth, words[node.ref][depth - base - 1], node.count, node.least)
                for column, value in zip(out, row):
                    column.append(value)
        names = ["key", "parent", "depth", "n_words", "n_convs", "owner"]
        return pa.RecordBatch.from_pydict(dict(zip(names, out)), schema=arrow)

    arrow = pa.schema(
        [("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n_words", pa.int64())]
        + [("n_convs", pa.int64()), ("owner", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, starts, words, held = ZFastTrie(), [], [], 0
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "start", "base", "keys", "words")]
            for member, start, base, keys, counts in zip(*columns):
                trie.insert(member, start, base, keys)
                starts.append(start)
                words.append(counts)
                held += len(counts)
                if held > TRIE_TURNS:
                    yield rows_of(trie, starts, words)
                    trie, starts, words, held = ZFastTrie(), [], [], 0
        if starts:
            yield rows_of(trie, starts, words)

    schema = f"key binary, parent binary, depth bigint, n_words bigint, n_convs bigint, owner {kind}"
    return segments.mapInArrow(run, schema)


def _joined_ids(ends: DataFrame) -> DataFrame:
    """`key` and `ends_sha256`, the digest of all ids that end there, in order and with commas between them.

    Blocks of ids become texts in parallel; the digest of a key then reads its
    texts in order, one at a time.
    """
    block = F.floor(F.col("conv_id") / ID_BLOCK).alias("block")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = ends.groupBy("key", block).agg(ids.alias("ids")).repartition("key").sortWithinPartitions("key", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [last], "ends_sha256": [state.hexdigest()]}, schema=arrow)

        for batch in batches:
            done: tuple[list, list] = ([], [])
            for key, text in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
                if key == last:
                    state.update(b"," + text.encode())
                    continue
                if last is not None:
                    done[0].append(last)
                    done[1].append(state.hexdigest())
                last, state = key, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pydict({"key": done[0], "ends_sha256": done[1]}, schema=arrow)
        if last is not None:
            yield closed()

    arrow = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    return texts.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def _key_at(place: Column) -> Column:
    return F.substring(F.col("keys"), ((place - 1) * KEY_BYTES + 1).cast("int"), F.lit(KEY_BYTES))


def nodes(rows: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each distinct prefix of the conversations of `paths` or `shared_heads`, the empty one included.

    `conv_id` is the least member and `parent_conv_id` that of the prefix one
    turn shorter (null for the empty one); `n_convs` members, `n_children`
    prefixes one turn longer, `n_leaves` childless prefixes of the subtree,
    `saved_tokens` the words that members after the first share in the subtree,
    and `ends_sha256` the digest of the ids that end there. Without
    conversations there are no rows. Keys have 16 bytes of a digest.
    """
    segments = _segments(rows, segment)
    merged = _expanded(segments).groupBy("key").agg(
        F.sum("n_convs").alias("n_convs"), F.min("owner").alias("owner"), F.max("depth").alias("depth"),
        F.max("parent").alias("parent"), F.max("n_words").alias("n_words"),
    )
    top = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner")).filter("n_convs > 0")
    top = top.select(
        F.lit(ROOT).alias("key"), "n_convs", "owner", F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("n_words"),
    )
    tree = materialise(merged.unionByName(top), "prefixes")

    children = tree.filter("parent is not null").groupBy(F.col("parent").alias("key"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    tree = tree.join(children, "key", "left").fillna(0, ["n_children"])
    tree = tree.withColumn("own", (F.col("n_convs") - 1) * F.col("n_words"))
    tree = materialise(tree, "prefixes")

    owners = tree.groupBy("owner").agg(
        F.sum("own").alias("owned"),
        F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaves"),
        (F.min("depth") - 1).alias("shared"),
    )
    # What a conversation owns counts once for each prefix on the part of its path that it shares.
    lower = owners.filter("shared >= 0 and (owned <> 0 or leaves <> 0)")
    along = segments.join(lower, segments["conv_id"] == lower["owner"]).filter("base <= shared")
    first = F.when(F.col("base") == 0, 0).otherwise(1)
    reach = F.least(F.col("shared") - F.col("base"), F.octet_length("keys") / KEY_BYTES).cast("bigint")
    places = along.filter(first <= reach).select("keys", "owned", "leaves", F.explode(F.sequence(first.cast("bigint"), reach)).alias("k"))
    below = places.select(
        F.when(F.col("k") == 0, F.lit(ROOT)).otherwise(_key_at(F.col("k"))).alias("key"), "owned", "leaves"
    )
    below = below.groupBy("key").agg(F.sum("owned").alias("below"), F.sum("leaves").alias("leaves_below"))

    before = ordered.running_total(tree, ["owner"], ["depth"], F.floor(F.col("depth") / segment), "own", "so_far")
    whole = before.join(owners.select("owner", "owned", "leaves"), "owner").join(below, "key", "left")
    last = segments.filter(F.col("total") <= F.col("base") + segment)
    ends = last.select(_key_at(F.col("total") - F.col("base")).alias("key"), "conv_id")
    ends = ends.unionByName(convs.filter("total = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    above = tree.select(F.col("key").alias("parent"), F.col("owner").alias("parent_conv_id"))
    whole = whole.join(_joined_ids(ends), "key", "left").join(above, "parent", "left")
    return whole.select(
        F.col("owner").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves") + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"),
        (F.col("owned") - F.col("so_far") + F.col("own") + F.coalesce("below", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


#: The same rows by SQL, over the shared heads of 20 conversations; prefixes are digests of all turns up to them.
ORACLE = r"""
WITH bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
           lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS at,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words
  FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS lender,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o) q, bits
), l AS (
  SELECT c.conv_id, h, lender, (SELECT least(count(*), h) FROM o WHERE o.conv_id = lender) AS lent FROM c
), r AS (
  SELECT l.conv_id, o.at + 1 AS depth, digest, n_words FROM l JOIN o ON o.conv_id = lender AND o.at < h
  UNION ALL
  SELECT l.conv_id, o.at - h + lent + 1, digest, n_words FROM l JOIN o ON o.conv_id = l.conv_id AND o.at >= h
), p AS (
  SELECT conv_id, depth, n_words,
         sha256(string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS key
  FROM r
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM l
), q AS (
  SELECT *, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), NULL) AS parent,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM p
), n AS (
  SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_words) AS n_words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM q GROUP BY key, depth
), m AS (
  SELECT n.*, (SELECT count(*) FROM n k WHERE k.parent = n.key) AS n_children FROM n
), s AS (
  SELECT p.key, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
         sum((m.n_convs - 1) * m.n_words)::BIGINT AS saved_tokens
  FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth
  GROUP BY p.key
)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN s ON s.key = m.key LEFT JOIN m u ON u.key = m.parent
"""
