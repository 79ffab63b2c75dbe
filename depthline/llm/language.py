"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams of a language in order. A text
is given the language whose profile is nearest to the text's own list: the
out-of-place distance adds up, over the text's n-grams, how far each stands from
its place in the profile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthline.llm import kernels as K
from depthline.session import materialise

_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class Rule:
    """`top` n-grams of up to three letters make a profile.

    Profiles are sent to all tasks: `top` rows for each language, of which there
    may be `most_languages`; more is an error, never a cut.
    """

    top: int = 300
    most_languages: int = 2000


def _letter_table() -> np.ndarray:
    """Lower-case letter of each code point, 0 for what is no letter."""
    if not _letters:
        out = np.zeros(0x110000, np.uint64)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of one to three letters of each text, packed, with the range of each text.

    Words are runs of letters; a word's edge counts as a letter of its own, so
    an n-gram may begin or end with it but never reaches into the next word.
    """
    points = [np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(p) + 2 for p in points], np.int64)
    ends = np.cumsum(sizes)
    data = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint32)
    for p, e in zip(points, ends):
        data[e - len(p) - 1 : e - 1] = p
    letter = _letter_table()[data]
    n = len(letter)
    first = np.zeros(n, bool)
    first[(ends - sizes)] = True  # a non-letter opens every text, so that no text joins the next
    gap = letter == 0
    keep = ~gap | ~np.concatenate([[False], gap[:-1]]) | first
    letter, text = letter[keep], np.repeat(np.arange(len(texts)), sizes)[keep]
    ahead = np.concatenate([letter, np.zeros(2, np.uint64)])
    x, y, z = letter, ahead[1:-1], ahead[2:]
    owner = np.concatenate([text, [-1, -1]])
    same_two, same_three = owner[1:-1] == text, owner[2:] == text
    one = x != 0
    two = same_two & ((x != 0) | (y != 0))
    three = same_three & (y != 0) & ((x != 0) | (z != 0))
    u = np.uint64
    mark = u(1) << u(63)
    all_grams = np.concatenate([x[one], ((x << u(21)) | y)[two] | (u(1) << u(62)), ((x << u(42)) | (y << u(21)) | z)[three] | mark])
    all_text = np.concatenate([text[one], text[two], text[three]])
    order = np.argsort(all_text, kind="stable")
    return all_grams[order], np.searchsorted(all_text[order], np.arange(len(texts) + 1))


def _ranked(values: np.ndarray, top: int) -> np.ndarray:
    """The most frequent values, most frequent first, smaller value first among equals."""
    found, count = np.unique(values, return_counts=True)
    return found[np.lexsort((found, -count))[:top]]


def profiles(texts: DataFrame, rule: Rule) -> DataFrame:
    """lang, gram and place (0 is the most frequent) learned from `texts(lang, text)`.

    Every task adds up its own texts before the shuffle; ties go to the smaller gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            values = np.concatenate([p[0] for p in parts])
            found, place = np.unique(values, return_inverse=True)
            return found, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                found, count = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(count)], ["lang", "gram", "n"]
                )
            held.clear()

        for batch in batches:
            langs, column = batch["lang"].to_pylist(), batch["text"].to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(column, langs) if x == lang]
                for i in range(0, len(own), 64):
                    values, _ = grams(own[i : i + 64])
                    found, count = np.unique(values, return_counts=True)
                    held.setdefault(lang, []).append((found, count))
                    if len(held[lang]) > 16:
                        held[lang] = [merged(held[lang])]
            if sum(len(p[0]) for parts in held.values() for p in parts) > 1_000_000:
                yield from flush()
        yield from flush()

    known = texts.filter("lang is not null and text is not null").select("lang", "text")
    counts = known.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("gram")]
    # The first places of each part of a language, then of the language: no task sorts a whole one.
    part = Window.partitionBy("lang", F.pmod(F.hash("gram"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    first = counts.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= rule.top)
    ranked = first.withColumn("place", F.row_number().over(whole) - 1).filter(F.col("place") < rule.top)
    return ranked.select("lang", "gram", F.col("place").cast("int").alias("place"))


class Judge:
    """Learned profiles as a table of places."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int):
        self.top = top
        self.langs = sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(self.langs)}
        gram = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        self.grams = np.unique(gram)
        self.places = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        self.places[np.searchsorted(self.grams, gram), [number[r[0]] for r in rows]] = [r[2] for r in rows]

    def nearest(self, values: np.ndarray) -> tuple[str, float]:
        """Language of the least distance (the first by name of equals) and 1 - distance / greatest distance."""
        own = _ranked(values, self.top)
        if not self.langs or not len(own):
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == own
        places = self.places[np.where(known, at, len(self.grams))]
        away = np.where(places >= 0, np.abs(places - np.arange(len(own))[:, None]), self.top)
        total = away.sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], float(1.0 - total[best] / (self.top * len(own)))


def identify(docs: DataFrame, learned: DataFrame, rule: Rule | None = None, keys: list[str] | None = None) -> DataFrame:
    """`keys`, lang_pred and score (0 to 1) of each row of `docs(text)`.

    Only the text is looked at, all of it. A text that is null or has no letter
    is `und` with score 0; so is every text if nothing was learned.
    """
    rule, keys = rule or Rule(), keys or ["doc_id"]
    n_langs = learned.select("lang").distinct().count()
    if n_langs > rule.most_languages:
        raise ValueError(f"{n_langs} languages; the bound is {rule.most_languages}")
    rows = [tuple(r) for r in learned.select("lang", "gram", "place").collect()]
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    own = docs.select(*keys, F.col("text").alias("__text"))
    schema = ", ".join(f"`{k}` {t}" for k, t in own.select(*keys).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value, rule.top)
        for batch in batches:
            column = batch["__text"]
            _, off = K.text_bytes(column)
            found: list[tuple[str, float]] = []
            for i, j in K.blocks(off):
                values, bounds = grams(column.slice(i, j - i).to_pylist())
                found += [judge.nearest(values[a:b]) if b > a else ("und", 0.0) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [*keys, "lang_pred", "score"],
            )

    return own.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id", part: int = 2, of: int = 4) -> Column:
    """Whether the checksum of the id as text falls in the part kept from training; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of == part, F.lit(False))


def predicted(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score; profiles are learned from the rows that aren't held out."""
    rule = rule or Rule()
    learned = materialise(profiles(docs.filter(~held_out()), rule), "profiles")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, learned, rule, ["doc_id", "held_out"])
