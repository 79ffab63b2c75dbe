"""Encoding and decoding with merge-type piece vocabularies.

The agenda of a text holds its adjacent pairs of symbols that form a piece, in
the order of score and then place; the best pair is joined until none is left,
and symbols that are no piece become byte pieces. No piece reaches across the
start of a run of spaces (U+0020 and U+2581) or a line end, so texts are cut there, and the agendas
of all different cuts of an Arrow batch are worked off side by side: one row of
pair scores for each cut, one join in every row at a time. Cuts of more than
`WIDE` symbols have a heap of their own. `mismatches` holds ids and text against
the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthline.llm import kernels as K

SPACE = "▁"
NORMAL, BYTE = 1, 6
#: Symbols in the widest table of pair scores.
WIDE = 64
_NEVER = np.int32(2**31 - 1)
_loaded: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces and merges of one model file, as lookup tables."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("a merge-type vocabulary with byte pieces is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only identity normalisation is supported")
        if not spec.add_dummy_prefix:
            raise ValueError("a vocabulary with a leading space is needed")
        pieces = model.pieces
        self.size = len(pieces)
        self.ids = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space after another character; texts can't be cut at spaces")
        self.score = {p.piece: p.score for p in pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)
        self.decimal = [str(i) for i in range(self.size)]
        self.surface = [
            p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b""
            for p in pieces
        ]
        joined = "".join(p for p in self.ids if len(p) > 1)
        self.alone = np.zeros(256, bool)  # line ends that no longer piece holds
        self.alone[[ord(c) for c in "\n\t\r" if c not in joined]] = True
        #: Symbol of each code point: its piece, or a number of its own beyond the pieces.
        self.symbol = np.arange(0x110000, dtype=np.int32) + np.int32(self.size)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        order = {s: n for n, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = np.full(self.size + 1, _NEVER, np.int32)
        for p, i in self.ids.items():
            self.rank[i] = order[self.score[p]]
        self._build_merges()

    def _build_merges(self) -> None:
        """Hash table with linear probing: pair of symbols to the piece that they form."""
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self._part(p[:k]), self._part(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(16, int(len(keys) * 8).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.size, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == -1)
            slots, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            left = np.ones(len(keys), bool)
            left[placed] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _part(self, p: str) -> int | None:
        if len(p) == 1:
            return int(self.symbol[ord(p)])
        return self.ids.get(p)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece that each pair forms, or `size` where there is none."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(self.size))
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = open_[found == keys[open_]]
            out[hit] = self.values[at[hit]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        return out

    def merge_rows(self, table: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Work off the agendas of all rows; `table` has a cut's symbols in each row."""
        rows = np.arange(len(table))
        done_table, done_length = table.copy(), length.copy()
        place = np.arange(table.shape[1] - 1)
        piece = self.merged(table[:, :-1].ravel(), table[:, 1:].ravel()).reshape(len(table), -1)
        piece[place[None, :] >= (length - 1)[:, None]] = self.size
        rank = self.rank[piece]
        while len(rows):
            best = rank.argmin(axis=1)
            every = np.arange(len(rows))
            busy = rank[every, best] != _NEVER
            if not busy.all():
                ended = ~busy
                done_table[rows[ended], : table.shape[1]], done_length[rows[ended]] = table[ended], length[ended]
                rows, table, length, piece, rank, best = (x[busy] for x in (rows, table, length, piece, rank, best))
                every = np.arange(len(rows))
                if not len(rows):
                    break
            joined = piece[every, best]
            width = int(length.max())
            table, piece, rank = table[:, :width], piece[:, : width - 1], rank[:, : width - 1]
            # The second symbol of the joined pair, and its pair with the third, go.
            later = np.arange(width - 1)[None, :] > best[:, None]
            table = np.where(later, table[:, 1:], table[:, :-1])
            table[every, best] = joined
            length = length - 1
            later = later[:, :-1] if width > 1 else later
            piece = np.where(np.arange(width - 2)[None, :] > best[:, None], piece[:, 1:], piece[:, :-1])
            rank = np.where(np.arange(width - 2)[None, :] > best[:, None], rank[:, 1:], rank[:, :-1])
            if width == 2:
                done_table[rows, :1], done_length[rows] = table, length
                break
            for side in (best - 1, best):
                ok = (side >= 0) & (side < length - 1)
                at, x = np.flatnonzero(ok), side[ok]
                new = self.merged(table[at, x], table[at, x + 1])
                piece[at, x], rank[at, x] = new, self.rank[new]
            past = np.flatnonzero(best == length - 1)  # the last symbol has no pair to its right
            past = past[length[past] - 1 < width - 2]
            piece[past, length[past] - 1], rank[past, length[past] - 1] = self.size, _NEVER
        return done_table, done_length

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The agenda of one cut of any length, as a heap."""
        row: list[int] = list(symbols)
        n = len(row)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        a = np.array(row, np.int32)
        first = self.merged(a[:-1], a[1:])
        agenda = [(int(self.rank[p]), i, i + 1, row[i], row[i + 1], int(p)) for i, p in enumerate(first) if p != self.size]
        heapq.heapify(agenda)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                p = int(self.merged(np.array([row[i]], np.int32), np.array([row[j]], np.int32))[0])
                if p != self.size:
                    heapq.heappush(agenda, (int(self.rank[p]), i, j, row[i], row[j], p))

        while agenda:
            _, i, j, left, right, p = heapq.heappop(agenda)
            if after[i] != j or row[i] != left or row[j] != right:
                continue
            row[i], row[j] = p, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -2
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in row if s >= 0]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block in a row, and the range of each text's ids."""
        sizes = np.diff(off)
        lead = (sizes > 0).astype(np.int64)
        new_off = np.concatenate([[0], np.cumsum(sizes + lead)])
        data = np.full(new_off[-1], 0x20, np.uint8)
        data[np.arange(len(buf)) + np.repeat(np.cumsum(lead), sizes)] = buf
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        space, alone = data == 0x20, self.alone[data]
        bar = np.flatnonzero(data[:-2] == 0xE2) if n > 2 else np.zeros(0, np.int64)
        bar = bar[(data[bar + 1] == 0x96) & (data[bar + 2] == 0x81)]
        for k in range(3):  # a literal U+2581 is the same symbol as a space
            space[bar + k] = True
        starts = np.zeros(n, bool)
        starts[new_off[:-1][sizes > 0]] = True
        starts[1:] |= (space[1:] & ~space[:-1]) | alone[:-1]
        starts |= alone
        cut = np.flatnonzero(starts)
        cut_end = np.append(cut[1:], n)
        key = K.span_hash(data, cut, cut_end)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        chars, char_off = _code_points(data)
        symbols = self.symbol[chars]
        lo = np.searchsorted(char_off, cut[first])
        length = np.searchsorted(char_off, cut_end[first]) - lo
        flat, flat_off = self._pieces_of_cuts(symbols, lo, length)
        count = np.diff(flat_off)[which]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.arange(total[-1]) + np.repeat(flat_off[which] - total[:-1], count)]
        return ids, total[np.searchsorted(cut, new_off)]

    def _pieces_of_cuts(self, symbols: np.ndarray, lo: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(lo), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # cut and symbol, in order within a cut
        low = 0
        for width in (1, 4, 8, 12, 16, 24, 40, WIDE):
            rows = np.flatnonzero((length > low) & (length <= width))
            low = width
            for part in (rows[i : i + 20_000] for i in range(0, len(rows), 20_000)):
                at = np.minimum(lo[part][:, None] + np.arange(width), len(symbols) - 1)
                table, left = symbols[at], length[part].astype(np.int64)
                if width > 1:
                    table, left = self.merge_rows(table, left)
                keep = np.arange(table.shape[1])[None, :] < left[:, None]
                parts.append((np.repeat(part, left), table[keep]))
                counts[part] = left
        for row in np.flatnonzero(length > WIDE):
            out = np.array(self.merge_one(symbols[lo[row] : lo[row] + length[row]].tolist()), np.int32)
            parts.append((np.full(len(out), row), out))
            counts[row] = len(out)
        cut = np.concatenate([p[0] for p in parts])
        piece = np.concatenate([p[1] for p in parts])
        order = np.argsort(cut, kind="stable")
        cut, piece = cut[order], piece[order]
        strange = np.flatnonzero(piece >= self.size)
        if len(strange):  # code points without a piece become the pieces of their bytes
            points = piece[strange] - self.size
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            each = np.ones(len(piece), np.int64)
            each[strange] = width
            place = np.concatenate([[0], np.cumsum(each)])
            out = np.empty(place[-1], np.int32)
            plain = np.ones(len(piece), bool)
            plain[strange] = False
            out[place[:-1][plain]] = piece[plain]
            for w in (1, 2, 3, 4):
                some = width == w
                for k in range(w):
                    shift = 6 * (w - 1 - k)
                    value = (points[some] >> shift) & (0x3F if w > 1 else 0x7F)
                    value = value | (0x80 if k else (0, 0, 0xC0, 0xE0, 0xF0)[w])
                    out[place[strange[some]] + k] = self.byte_ids[value]
            cut, piece = np.repeat(cut, each), out
        return piece, np.searchsorted(cut, np.arange(len(lo) + 1))

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the place of each one's first byte."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[at].astype(np.int32)
    if len(at) == len(data):
        return b, at
    last = len(data) - 1
    more = [data[np.minimum(at + k, last)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
    two = ((b & 0x1F) << 6) | more[0]
    three = ((b & 0x0F) << 12) | (more[0] << 6) | more[1]
    four = ((b & 0x07) << 18) | (more[0] << 12) | (more[1] << 6) | more[2]
    return np.where(b < 0x80, b, np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))), at


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _encoded(batch: pa.RecordBatch, v: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, off = K.text_bytes(batch["__text"])
    for i, j in K.blocks(off, 4 * K.BLOCK_BYTES):
        yield i, j, *v.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])


def _keyed(docs: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, str]:
    rows = docs.select(*keys, F.col(text).alias("__text"))
    return rows, ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)


def encode(docs: DataFrame, model: str, keys: list[str], text: str = "text") -> DataFrame:
    """`keys`, ids (array<int>), n_tokens and the decoded text of every whole text.

    A null or empty text has no ids and decodes to the empty text. Repeated rows
    give repeated rows; other columns are left out, whatever their names.
    """
    rows, schema = _keyed(docs, keys, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for i, j, ids, bounds in _encoded(batch, v):
                decoded = [v.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(i, j - i) for c in batch.columns[:-1]],
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                        pa.array(np.diff(bounds)),
                        pa.array(decoded, pa.string()),
                    ],
                    [*keys, "ids", "n_tokens", "decoded"],
                )

    return rows.mapInArrow(run, f"{schema}, ids array<int>, n_tokens bigint, decoded string")


def encode_digests(docs: DataFrame, model: str, keys: list[str], text: str = "text") -> DataFrame:
    """As `encode`, with SHA-256 digests in place of ids and decoded text.

    `ids_sha256` is that of the decimal ids joined by commas. The digests are
    taken where the ids are made, so that no list of ids crosses to the JVM.
    """
    rows, schema = _keyed(docs, keys, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for i, j, ids, bounds in _encoded(batch, v):
                first, second = [], []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    row = ids[a:b].tolist()
                    first.append(hashlib.sha256(",".join(map(v.decimal.__getitem__, row)).encode()).hexdigest())
                    second.append(hashlib.sha256(v.decode(row).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(i, j - i) for c in batch.columns[:-1]],
                        pa.array(np.diff(bounds)),
                        pa.array(first, pa.string()),
                        pa.array(second, pa.string()),
                    ],
                    [*keys, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return rows.mapInArrow(run, f"{schema}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def mismatches(docs: DataFrame, model: str, keys: list[str], text: str = "text") -> DataFrame:
    """`keys` of the texts whose ids or decoded text differ from the sentencepiece library's."""
    rows, _ = _keyed(docs, keys, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        v = vocabulary(model)
        for batch in batches:
            want = library.encode([t or "" for t in batch["__text"].to_pylist()], num_threads=1)
            differs = []
            for i, _, ids, bounds in _encoded(batch, v):
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    row = ids[a:b].tolist()
                    differs.append(row != want[i + k] or v.decode(row) != library.decode(row))
            yield batch.filter(pa.array(differs, pa.bool_())).select(keys)

    return rows.mapInArrow(run, rows.select(*keys).schema)
