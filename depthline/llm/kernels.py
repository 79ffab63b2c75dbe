"""Text kernels for Arrow batches: bytes, words and hashes of whole texts as numpy arrays.

A batch of texts is looked at as one byte array with offsets; nothing is decoded
or looped over by text unless a caller needs to. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at a time, so that the working arrays stay in the cache.
BLOCK_BYTES = 256 * 1024

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_HASH = np.random.RandomState(20240229).randint(1, 2**31 - 1, 256, dtype=np.int64).astype(U)
_BASE = 0x9E3779B97F4A7C15
#: Spans are hashed by two polynomials over a prime field; one modulo a power of two has spans that collide for every base.
_PRIME = 2**31 - 1
_BASES = (1_147_483_629, 628_318_531)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text makes a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the range of words of each text."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    body = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = body[:-1]
    before &= ~edge[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = body[1:]
    after &= ~edge[1:]
    start = np.flatnonzero(body & ~before)
    end = np.flatnonzero(body & ~after) + 1
    return start, end, np.searchsorted(start, off)


def _powers_of(base: int, size: int) -> np.ndarray:
    out = np.ones(size, U)
    have = 1
    while have < size:
        step = U(pow(base, have, _PRIME))
        out[have : 2 * have] = out[:have] * step % U(_PRIME)
        have *= 2
    return out


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, for `n` places or more."""
    size = 1 << max(12, int(n).bit_length())
    if (base, size) not in _powers:
        _powers[base, size] = _powers_of(base, size), _powers_of(pow(base, -1, _PRIME), size)
    return _powers[base, size]


def running_hash(first: np.ndarray, second: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from starts and ends to 64-bit hashes of the values between, from two running polynomials.

    Each value is a pair of numbers below the prime, one for each polynomial.
    Equal runs have equal hashes wherever they stand.
    """
    n, sums, term = len(first), [], np.empty(len(first), U)
    for base, values in zip(_BASES, (first, second)):
        np.multiply(values, _power_tables(base, n)[0][:n], out=term)
        np.remainder(term, U(_PRIME), out=term)
        total = np.zeros(n + 1, U)
        np.cumsum(term, out=total[1:])
        sums.append(total)

    def between(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.asarray(end - start).astype(U)
        for base, total in zip(_BASES, sums):
            part = total[end]
            part -= total[start]
            np.remainder(part, U(_PRIME), out=part)
            part *= _power_tables(base, n)[1][start]
            np.remainder(part, U(_PRIME), out=part)
            out = mix(out + (part << U(32)) + part)
        return out

    return between


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    values = _BYTE_HASH[buf]
    return running_hash(values, values)(start, end)


def run_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every `k` consecutive values (n - k + 1 of them)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = mix(out + values[j : j + n] + U((_BASE * (j + 1)) % 2**64))
    return out


def inside(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where `k` consecutive items lie in one text, and how many each text has."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(counts.sum()) + first, counts


def shingles(word_hash: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `k`-word shingles of each text, with the range of each text.

    A text of 1 to k-1 words has its whole sequence as its one shingle.
    """
    at, counts = inside(bounds, k)
    n_words = np.diff(bounds)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    counts = counts.copy()
    counts[short] = 1
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(out_bounds[-1], U)
    long_rows = np.ones(len(out), bool)
    long_rows[out_bounds[short]] = False
    out[long_rows] = run_hash(word_hash, k)[at]
    for size in range(1, k):
        rows = short[n_words[short] == size]
        if len(rows):
            h = np.full(len(rows), U(size * 7919))
            for j in range(size):
                h = mix(h + word_hash[bounds[rows] + j] + U((_BASE * (j + 1)) % 2**64))
            out[out_bounds[rows]] = h
    return out, out_bounds


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def covered(start: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of `n` places lie in a window of `width` that begins at one of `start`."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, np.minimum(start + width, n), -1)
    return np.cumsum(delta[:-1]) > 0
