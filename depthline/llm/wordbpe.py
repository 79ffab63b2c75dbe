"""Encoding and decoding with a word-end BPE vocabulary, through a table of distinct words.

Texts are split into words in Spark tasks. A block of texts has one list of its
distinct words and, for each text, the places of its words in that list. All
blocks' lists are shuffled by word, so that each distinct word is encoded once;
the ids go back to the blocks and are joined to the texts by place. A word
travels once for each block that holds it and not once for each time that it
stands there. Ids are decoded through a join with the pieces of the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text of a block, in characters; a longer text is a block of its own.
BLOCK_CHARS = 32 << 20
#: Places that a task packs at a time before it sends them back to their blocks.
PACKED_PLACES = 4_000_000
#: Words with more symbols than this have a heap of pairs.
LONG_WORD = 48

# The settings that a vocabulary file must have, and what its
# splitting pattern takes as white space.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# Letters, numbers and lower cases of code points that are newer
# than version 15.1 of the Unicode tables.
_NEWER_LETTERS = (
    "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85"
    "\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3"
    "\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff"
    "\U0001e5d0-\U0001e5ed\U0001e5f0"
)
_NEWER_NUMBERS = (
    "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79"
    "\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
)
_NEWER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
    0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
#: Code points that need the wide classes or the newer lower cases.
_RARE = re.compile("[\u1c89\ua7cb-\ua7dc\U00010000-\U0010ffff]")
_loaded: dict[str, Vocabulary] = {}


def _ranges(kind: str, newer: str, top: int) -> str:
    """The code points of a general category up to `top`, as the inside of a character class."""
    held = {c for c in range(top + 1) if unicodedata.category(chr(c))[0] == kind}
    for first, last in re.findall("(.)(?:-(.))?", newer):
        held.update(c for c in range(ord(first), ord(last or first) + 1) if c <= top)
    starts = sorted(c for c in held if c - 1 not in held)
    ends = sorted(c for c in held if c + 1 not in held)
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte: itself, or one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Pieces, merges and the splitting rule of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != _NORMALIZERS or split[0]["pattern"]["Regex"] != _PATTERN or split[1]["use_regex"]:
            raise ValueError("another way of splitting texts than this module's")
        if spec["decoder"] or model["type"] != "BPE" or model["unk_token"] or model["continuing_subword_prefix"]:
            raise ValueError("a BPE vocabulary without an unknown piece, prefixes and a decoder is needed")
        end, ids = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that match as plain text are needed")
        self.pieces = {i: p for p, i in [*ids.items(), *self.special.items()]}
        self.in_order = [self.pieces.get(i, "") for i in range(max(self.pieces) + 1)]
        letters = byte_alphabet()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + end] for c in letters]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self._word = {top: self._pattern(top) for top in (0xFFFF, sys.maxunicode)}
        self._parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    @staticmethod
    def _pattern(top: int) -> re.Pattern:
        """What a word is, in texts without code points over `top` (small classes are searched far faster)."""
        letter, number = _ranges("L", _NEWER_LETTERS, top), _ranges("N", _NEWER_NUMBERS, top)
        return re.compile(f"{_CONTRACTIONS}|[{letter}]+|[{number}]|[^{_SPACES}{letter}{number}]+")

    def words(self, text: str) -> list[str]:
        """Words of a text in order; special tokens that stand in it are words."""
        if "<|" not in text:
            return self._plain_words(text)
        out = []
        for k, part in enumerate(self._parts.split(text)):
            out += [part] if k % 2 else self._plain_words(part)
        return out

    def _plain_words(self, text: str) -> list[str]:
        if text.isascii():
            return self._word[0xFFFF].findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        top = 0xFFFF
        if _RARE.search(text):
            text, top = text.translate(_NEWER_LOWER), sys.maxunicode
        return self._word[top].findall(text.replace("\u03a3", "\u03c3").lower())  # a sigma has one lower case

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word: the pair with the least rank is joined, the leftmost of equals, until none is left."""
        if word in self.special:
            return [self.special[word]]
        data = word.encode()
        row = [self.inner[b] for b in data[:-1]]
        row.append(self.last[data[-1]])
        if len(row) > LONG_WORD:
            return self._encode_long(row)
        merges, never = self.merges, (len(self.pieces) + len(self.merges), -1)
        pairs = [merges.get(p, never) for p in zip(row, row[1:])]
        while pairs:
            best = min(pairs)
            if best is never:
                break
            k = pairs.index(best)
            row[k : k + 2] = [best[1]]
            del pairs[k]
            if k:
                pairs[k - 1] = merges.get((row[k - 1], row[k]), never)
            if k < len(pairs):
                pairs[k] = merges.get((row[k], row[k + 1]), never)
        return row

    def _encode_long(self, row: list[int]) -> list[int]:
        n = len(row)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        pairs = ((i, pair) for i, pair in enumerate(zip(row, row[1:])) if pair in self.merges)
        agenda = [(self.merges[pair][0], i, i + 1, pair, self.merges[pair][1]) for i, pair in pairs]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair, made = heapq.heappop(agenda)
            if after[i] != j or (row[i], row[j]) != pair:
                continue
            row[i], row[j] = made, -1
            after[i], after[j] = after[j], -2
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (row[x], row[y]) in self.merges:
                    rank, found = self.merges[row[x], row[y]]
                    heapq.heappush(agenda, (rank, x, y, (row[x], row[y]), found))
        return [s for s in row if s >= 0]


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


@dataclass
class _Block:
    """Texts of one task, looked at together: distinct units in the order in which they come first."""

    index: dict = field(default_factory=dict)
    places: array = field(default_factory=lambda: array("I"))
    counts: list = field(default_factory=list)
    slices: list = field(default_factory=list)
    size: int = 0

    def name(self, number: int) -> bytes:
        """Task, number in the task, and a digest of the units: the same each time that the texts are read."""
        place = (TaskContext.get().partitionId() << 32 | number).to_bytes(8, "big")
        return place + hashlib.sha256("\0".join(map(str, self.index)).encode()).digest()[:8]


def _cut(batches: Iterator[pa.RecordBatch], split: Callable[[], Callable]) -> Iterator[tuple[bytes, _Block]]:
    """Blocks of the rows of a task; `split()` gives the function from a column to sizes and lists of units."""
    cut, block, number = split(), _Block(), 0
    for batch in batches:
        first = 0
        for k, (size, units) in enumerate(cut(batch["__value"])):
            if block.counts and block.size + size > BLOCK_CHARS:
                block.slices.append(batch.slice(first, k - first))
                yield block.name(number), block
                block, number, first = _Block(), number + 1, k
            index = block.index
            block.places.extend([index.setdefault(u, len(index)) for u in units])
            block.counts.append(len(units))
            block.size += size
        block.slices.append(batch.slice(first))
    if block.counts:
        yield block.name(number), block


def _units(rows: DataFrame, split: Callable[[], Callable], unit: str) -> DataFrame:
    """`block`, `at` and `unit` of all distinct units of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _cut(batches, split):
            units = pa.array(list(block.index), pa.string() if unit == "string" else pa.int32())
            for i in range(0, len(units), 100_000):
                part = units.slice(i, 100_000)
                at = pa.array(np.arange(i, i + len(part), dtype=np.int32))
                named = pa.repeat(pa.scalar(name, pa.binary()), len(part))
                yield pa.RecordBatch.from_arrays([named, at, part], ["block", "at", "unit"])

    return rows.mapInArrow(run, f"block binary, at int, unit {unit}")


def _places(rows: DataFrame, keys: list[str], split: Callable[[], Callable]) -> DataFrame:
    """`block`, `rows` (keys and number of units of each row) and the packed `places` of their units."""
    fields = ", ".join([*[f"`{k}`: {t}" for k, t in rows.select(*keys).dtypes], "`__n`: bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in _cut(batches, split):
            held = [pa.concat_arrays([s[k] for s in block.slices]) for k in keys]
            struct = pa.StructArray.from_arrays([*held, pa.array(block.counts, pa.int64())], [*keys, "__n"])
            packed = _packed(np.frombuffer(block.places, np.uint32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct),
                    pa.array([packed], pa.binary()),
                ],
                ["block", "rows", "places"],
            )

    return rows.mapInArrow(run, f"block binary, rows array<struct<{fields}>>, places binary")


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _assembled(places: DataFrame, payload: DataFrame, keys: list[str], finish: Callable, made: str) -> DataFrame:
    """Rows of all blocks with what `finish` makes of their places and of the block's rows of `payload`."""
    kinds = dict(places.selectExpr("inline(rows)").dtypes)
    names = [part.split()[0] for part in made.split(", ")]

    def run(block: pa.Table, units: pa.Table) -> pa.Table:
        if not block.num_rows:
            raise RuntimeError("the texts were not the same when they were read again; write the table first")
        rows = block["rows"].combine_chunks().flatten()
        at = _unpacked(block["places"][0].as_py())
        columns = finish(units, at, np.concatenate([[0], np.cumsum(rows.field("__n").to_numpy())]))
        return pa.Table.from_arrays([*[rows.field(k) for k in keys], *columns], [*keys, *names])

    whole = places.withColumnRenamed("block", "of").groupBy("of")
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], made])
    return whole.cogroup(payload.groupBy("block")).applyInArrow(run, schema)


def _rows(docs: DataFrame, keys: list[str], column: str) -> DataFrame:
    return docs.select(*keys, F.col(column).alias("__value"))


def encoded_words(units: DataFrame, model: str) -> DataFrame:
    """Ids of all units, packed for each block: places, numbers of ids, and ids.

    Units are shuffled by word and sorted, so each distinct word is encoded once,
    whatever the number of its blocks. A task sends a block's places back in one
    row, or in one for every `PACKED_PLACES` that the task has read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        held: dict[bytes, tuple[array, array, array]] = {}
        n, last, ids = 0, None, []

        def flush() -> pa.RecordBatch:
            columns = [[_packed(np.frombuffer(c[k], np.uint32)) for c in held.values()] for k in range(3)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary()) for c in (list(held), *columns)], ["block", "at", "counts", "ids"]
            )

        for batch in batches:
            for block, at, unit in zip(*(c.to_pylist() for c in batch.columns)):
                if unit != last:
                    last, ids = unit, v.encode_word(unit)
                if block not in held:
                    held[block] = array("I"), array("I"), array("I")
                places, counts, flat = held[block]
                places.append(at)
                counts.append(len(ids))
                flat.extend(ids)
                n += 1
            if n > PACKED_PLACES:
                yield flush()
                held, n = {}, 0
        if held:
            yield flush()

    by_word = units.repartition("unit").sortWithinPartitions("unit")
    return by_word.mapInArrow(run, "block binary, at binary, counts binary, ids binary")


def _split_texts(model: str) -> Callable[[], Callable]:
    def start():
        v = vocabulary(model)

        def cut(column: pa.Array):
            for value in column:
                text = value.as_py() or ""
                yield len(text), v.words(text)

        return cut

    return start


def _split_ids() -> Callable:
    def cut(column: pa.Array):
        for value in column:
            ids = [i for i in value.as_py() or [] if i is not None]
            yield 8 * len(ids), ids

    return cut


def _joined_ids(payload: pa.Table, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a block one after the other, and each row's range of them."""
    parts = [[_unpacked(x) for x in payload[c].to_pylist()] for c in ("at", "counts", "ids")]
    place, count, flat = (np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts)
    starts = np.cumsum(count, dtype=np.int64) - count
    if len(place) != (at.max() + 1 if len(at) else 0):
        raise RuntimeError("the texts were not the same when they were read again; write the table first")
    start_of, count_of = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    start_of[place], count_of[place] = starts, count
    n = count_of[at]
    total = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(total[-1]) + np.repeat(start_of[at] - total[:-1], n)], total[bounds]


def _decoded(ids: np.ndarray, ranges: np.ndarray, model: str) -> Iterator[str]:
    """Texts of ranges of ids: a map-side join of the ids with the pieces, which stand in the order of their ids."""
    piece = vocabulary(model).in_order.__getitem__
    for a, b in zip(ranges[:-1].tolist(), ranges[1:].tolist()):
        yield " ".join(map(piece, ids[a:b].tolist()))


def _encoded(docs: DataFrame, model: str, keys: list[str], text: str, finish: Callable, made: str) -> DataFrame:
    rows, split = _rows(docs, keys, text), _split_texts(model)

    def run(payload: pa.Table, at: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        ids, ranges = _joined_ids(payload, at, bounds)
        return [pa.array(np.diff(ranges)), *finish(ids.astype("<u4"), ranges)]

    payload = encoded_words(_units(rows, split, "string"), model)
    return _assembled(_places(rows, keys, split), payload, keys, run, f"n_tokens bigint, {made}")


def encode(docs: DataFrame, model: str, keys: list[str], text: str = "text") -> DataFrame:
    """`keys`, n_tokens, ids (array<int>) and the decoded text of every whole text.

    A null or empty text has no ids and decodes to the empty text. Repeated rows
    give repeated rows, null keys are kept, and other columns are left out,
    whatever their names. A text of any length is at most one block; a word of
    any length is one row. Code points that Python's Unicode tables don't know
    are taken as they stand when a text is composed.

    The table is read twice, once for its words and once for their places, which
    needs less disk than a copy of it. It has to give the same rows in the same
    tasks both times, as tables of files do; if it doesn't, the job fails.
    """

    def finish(ids: np.ndarray, ranges: np.ndarray) -> list[pa.Array]:
        lists = pa.ListArray.from_arrays(pa.array(ranges.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return [lists, pa.array(_decoded(ids, ranges, model), pa.string())]

    return _encoded(docs, model, keys, text, finish, "ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str, keys: list[str], text: str = "text") -> DataFrame:
    """As `encode`, with SHA-256 digests in place of ids and decoded text.

    `ids_sha256` is that of the ids as little-endian unsigned 32-bit numbers.
    The digests are taken where the ids are put together, so that no list of
    ids crosses to the JVM.
    """

    def finish(ids: np.ndarray, ranges: np.ndarray) -> list[pa.Array]:
        data, spans = ids.tobytes(), zip(ranges[:-1].tolist(), ranges[1:].tolist())
        of_ids = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in spans]
        of_text = [hashlib.sha256(t.encode()).hexdigest() for t in _decoded(ids, ranges, model)]
        return [pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    return _encoded(docs, model, keys, text, finish, "ids_sha256 string, decoded_sha256 string")


def decode(rows: DataFrame, model: str, keys: list[str], ids: str = "ids") -> DataFrame:
    """`keys` and the decoded text of every list of ids: its pieces, joined by spaces.

    The distinct ids of each block are joined with the table of pieces and go
    back to the rows by place. A null or empty list decodes to the empty text;
    ids without a piece and null ids are passed over. Repeated rows give repeated
    rows. `rows` is read twice, as the texts of `encode`.
    """

    def finish(payload: pa.Table, at: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        piece = dict(zip(payload["at"].to_pylist(), payload["piece"].to_pylist()))
        texts = [
            " ".join([piece[p] for p in at[a:b].tolist() if piece[p] is not None])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
        ]
        return [pa.array(texts, pa.string())]

    held = _rows(rows, keys, ids)
    pieces = rows.sparkSession.createDataFrame(sorted(vocabulary(model).pieces.items()), "unit int, piece string")
    # The table of pieces has the size of the vocabulary, which bounds its broadcast.
    payload = _units(held, _split_ids, "int").join(F.broadcast(pieces), "unit", "left").drop("unit")
    return _assembled(_places(held, keys, _split_ids), payload, keys, finish, "decoded string")
