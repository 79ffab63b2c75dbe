"""Fill-in-the-middle: texts cut at token boundaries that a compressed set of offsets holds.

The boundaries of a block of texts form one set of offsets, cut into containers
of 2**16 offsets. A container is an array, a bitmap or a list of runs, whichever
is smallest, and the set knows how many offsets lie before each container. A
cut after k tokens is the k-th boundary: a search over the cumulative counts
finds its container, and a select inside the container gives its offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthline.llm import kernels as K

#: Offsets of a container share all bits but their lowest 16.
LOW_BITS = 16
_BITMAP_BYTES = 1 << (LOW_BITS - 3)


class ArrayContainer:
    """Offsets in order, two bytes each."""

    def __init__(self, low: np.ndarray):
        self.low = low

    def select(self, ranks: np.ndarray) -> np.ndarray:
        return self.low[ranks].astype(np.int64)


class BitmapContainer:
    """One bit for each offset, with the number of bits before each 64-bit word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << LOW_BITS, np.uint8)
        bits[low] = 1
        self.bytes = np.packbits(bits, bitorder="little").reshape(-1, 8)
        self.before = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1))])

    def select(self, ranks: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, ranks, side="right") - 1
        bits = np.unpackbits(self.bytes[word], axis=1, bitorder="little")
        inside = (np.cumsum(bits, axis=1) > (ranks - self.before[word])[:, None]).argmax(axis=1)
        return word * 64 + inside


class RunContainer:
    """First offset of each run of neighbours, with the number of offsets before each run."""

    def __init__(self, start: np.ndarray, length: np.ndarray):
        self.start = start
        self.before = np.concatenate([[0], np.cumsum(length)])

    def select(self, ranks: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, ranks, side="right") - 1
        return self.start[run].astype(np.int64) + ranks - self.before[run]


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of sorted, distinct 16-bit offsets."""
    first = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
    if 4 * len(first) < min(2 * len(low), _BITMAP_BYTES):
        return RunContainer(low[first], np.diff(np.append(first, len(low))))
    return ArrayContainer(low) if 2 * len(low) <= _BITMAP_BYTES else BitmapContainer(low)


class BoundarySet:
    """A set of offsets (sorted, distinct) that answers which one has a given rank."""

    def __init__(self, offsets: np.ndarray):
        self.high, first = np.unique(offsets >> LOW_BITS, return_index=True)
        self.before = np.append(first, len(offsets))
        low = (offsets & ((1 << LOW_BITS) - 1)).astype(np.uint16)
        self.containers = [container(low[a:b]) for a, b in zip(self.before[:-1], self.before[1:])]

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Offsets of the given ranks, counted from 0."""
        which = np.searchsorted(self.before, ranks, side="right") - 1
        out = np.empty(len(ranks), np.int64)
        for c in np.unique(which):
            rows = np.flatnonzero(which == c)
            inside = self.containers[c].select(ranks[rows] - self.before[c])
            out[rows] = (self.high[c] << LOW_BITS) + inside
        return out


@dataclass(frozen=True)
class Rule:
    """How texts are cut and put together again.

    `unit` is `word` (white space and the word after it, or white space at the
    end of a text) or `char` (a code point). `seed` and the document's id decide
    everything at random. `plain_from` to 99 of 100 documents stay as they are;
    of the others, those under `spm_below` of 100 have the suffix first.
    """

    unit: str = "word"
    seed: int = 42
    plain_from: int = 50
    spm_below: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _draws(doc_id: Column, rule: Rule) -> list[Column]:
    """Four unsigned 32-bit numbers from the seed and an id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def token_ends(buf: np.ndarray, off: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the tokens of all texts of a block, in bytes, and how many each text has."""
    size = np.diff(off)
    if unit == "char":
        first = np.flatnonzero((buf & 0xC0) != 0x80)
        return np.append(first[1:], len(buf)) if len(first) else first, np.diff(np.searchsorted(first, off))
    _, end, bounds = K.words(buf, off)
    full = np.flatnonzero(size > 0)
    last_word = np.full(len(size), -1)
    some = np.flatnonzero(np.diff(bounds) > 0)
    last_word[some] = end[bounds[some + 1] - 1]
    trailing = full[last_word[full] != off[full + 1]]
    count = np.diff(bounds)
    count[trailing] += 1
    return np.sort(np.concatenate([end, off[trailing + 1]])), count


def _block(texts: pa.Array, draws: list[np.ndarray], rule: Rule) -> list[pa.Array]:
    buf, off = K.text_bytes(texts)
    ends, n = token_ends(buf, off, rule.unit)
    # One boundary at 0 and one after each token; the end of a text is the start of the next.
    boundaries = BoundarySet(np.concatenate([[0], ends]))
    base = np.cumsum(n) - n
    first, second = draws[0] % (n + 1), draws[1] % (n + 1)
    cut = [boundaries.select(base + part(first, second)) for part in (np.minimum, np.maximum)]
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    plain = (np.diff(off) == 0) | (draws[2] % 100 >= rule.plain_from)
    filled = pc.fill_null(texts, "")
    for marker in rule.markers:
        plain |= pc.match_substring(filled, marker).to_numpy(zero_copy_only=False)
    spm = ~plain & (draws[3] % 100 < rule.spm_below)
    data = buf.tobytes()
    p, s, m = (x.encode() for x in rule.markers)
    out = []
    for a, b, c, d, as_is, turned in zip(off[:-1].tolist(), cut[0].tolist(), cut[1].tolist(), off[1:].tolist(), plain, spm):
        if as_is:
            out.append(data[a:d])
        elif turned:
            out.append(b"".join((s, data[c:d], p, data[a:b], m, data[b:c])))
        else:
            out.append(b"".join((p, data[a:b], s, data[c:d], m, data[b:c])))
    return [
        pa.array(n, pa.int64()),
        pa.array(np.select([plain, spm], ["plain", "spm"], "psm"), pa.string()),
        pa.array(chars[cut[0]] - chars[off[:-1]], pa.int64(), mask=plain),
        pa.array(chars[cut[1]] - chars[cut[0]], pa.int64(), mask=plain),
        pa.array(out, pa.binary()).cast(pa.string()),
    ]


def transform(
    docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text", keys: list[str] | None = None
) -> DataFrame:
    """`keys` (else the id), `n` tokens, `form`, `prefix_chars`, `middle_chars` and `output` of every whole text.

    A null text is empty. Empty texts, and texts that hold a marker, are plain,
    as the others are by their draw; the two counts are null there. A null id is
    drawn for as if it were the empty text; repeated rows give repeated rows.
    Other columns are left out, whatever their names. A text of any length is a
    block of its own at most.
    """
    keys = keys or [doc_id]
    drawn = [d.alias(f"__h{k}") for k, d in enumerate(_draws(F.col(doc_id), rule))]
    rows = docs.select(*keys, *drawn, F.col(text).alias("__text"))
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = [batch[f"__h{k}"].to_numpy() for k in range(4)]
            for i, j in K.blocks(K.text_bytes(batch["__text"])[1], 4 * K.BLOCK_BYTES):
                made = _block(batch["__text"].slice(i, j - i), [d[i:j] for d in draws], rule)
                yield pa.RecordBatch.from_arrays(
                    [*[batch[k].slice(i, j - i) for k in keys], *made], [*keys, *names]
                )

    kept = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    return rows.mapInArrow(
        run, f"{kept}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(output: Column, form: Column, rule: Rule = Rule()) -> Column:
    """The text that an output of `transform` was made of; no cut text holds a marker, so markers split it."""
    quoted = "|".join("\\Q" + m + "\\E" for m in rule.markers)
    part = F.split(output, quoted, -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


#: The same rows by SQL: tokens by a pattern, slices of the list of tokens joined.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), k AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT doc_id, t, w, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a,
         greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m,
         array_to_string(w[b + 1:], '') AS s
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
