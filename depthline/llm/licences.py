"""Licence scans: phrases in place, and an exact set-similarity join with notice templates.

A text block is a line of a document, or a window of words over the whole text a
little longer than the template, as the set of its words; windows find notices
that are wrapped over lines. A template is found where it is contained in a
block: 100 * |template & block| >= percent * |template|. Words are ordered by how
many documents hold them, rarest first. Only lines that pass the prefix, length
and positional filters of that order are compared, and only windows that begin
at a template word, of documents that hold enough of the template; the filters
drop no block that meets the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of the base scan and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short forms of public licence notices (fixed values) and their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "mit",
    ),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version", "gpl"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution license", "cc-by"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "bsd",
    ),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)


@dataclass(frozen=True)
class Rule:
    phrases: tuple[tuple[str, str], ...] = PHRASES
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    percent: int = 90
    slack: int = 25  # percent by which a window is longer than its template
    vocabulary: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "vocabulary", tuple(sorted({w for t, _ in self.templates for w in t.split()})))

    def least(self, template: str) -> int:
        """Words of a template that a block has to share."""
        return -(-self.percent * len(set(template.split())) // 100)

    def width(self, template: str) -> int:
        """Words of a window that a template is sought in."""
        return -(-(100 + self.slack) * len(template.split()) // 100)


def words(text: Column) -> Column:
    """Lower-case words (A-Z only) of a text; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(plain, _SEPARATORS), "")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(tokens: Column, phrase: str) -> Column:
    """First words of the places where the words of a phrase stand in a row."""
    parts = phrase.split()
    last = F.size(tokens) - len(parts)
    there = lambda i: reduce(lambda a, b: a & b, [F.get(tokens, i + k) == w for k, w in enumerate(parts)])
    seek = F.filter(F.sequence(F.lit(0), last), there)
    some = reduce(lambda a, b: a & b, [F.array_contains(tokens, w) for w in parts]) & (last >= 0)
    return F.when(some, seek).otherwise(F.array().cast("array<int>"))


def document_frequency(docs: DataFrame, rule: Rule) -> dict[str, int]:
    """How many documents hold each word of the templates; as many rows as the templates have words."""
    held = docs.select(F.explode(F.array_intersect(_strings(rule.vocabulary), words(F.col("text")))).alias("word"))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def _contained(block: Column, ordered: list[str], rule: Rule, template: str) -> Column:
    """Share of the template that the block holds, if it meets the threshold, else 0.

    `block` has the block's template words, rarest first.
    """
    need = rule.least(template)
    own = set(template.split())
    row = [w for w in ordered if w in own]
    length = F.size(block) >= need
    candidates = []
    for i, word in enumerate(row[: len(row) - need + 1]):  # a match shares one of the rarest words
        j = F.array_position(block, F.lit(word))
        left = F.least(F.lit(len(row) - i - 1), F.size(block) - j.cast("int"))
        candidates.append((j > 0) & (left + 1 >= need))  # and enough words can follow it on both sides
    prefix = reduce(lambda a, b: a | b, candidates)
    shared = F.size(F.array_intersect(block, _strings(row)))
    return F.when(length & prefix & (shared >= need), shared / F.lit(float(len(row)))).otherwise(F.lit(0.0))


def _share_of(ordered: list[str], rule: Rule, template: str) -> Callable[[Column], Column]:
    return lambda block: _contained(block, ordered, rule, template)


def _in_windows(tokens: Column, held: Column, ordered: list[str], rule: Rule, template: str) -> Column:
    """Largest share of the template that a window of `tokens` holds, if it meets the threshold, else 0.

    `held` has the template words of the whole text. A window that meets the
    threshold still does when it is moved on to its first template word.
    """
    need, width = rule.least(template), rule.width(template)
    own = set(template.split())
    row = _strings([w for w in ordered if w in own])
    places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.array_contains(row, F.get(tokens, i)))
    window = lambda i: F.transform(F.sequence(i, F.least(i + width, F.size(tokens)) - 1), lambda k: F.get(tokens, k))
    most = F.array_max(F.transform(places, lambda i: F.size(F.array_intersect(row, window(i)))))
    enough = F.size(F.array_intersect(held, row)) >= need
    return F.when(enough, F.when(most >= need, most / F.lit(float(len(own))))).otherwise(F.lit(0.0))


def scan(docs: DataFrame, rule: Rule | None = None, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keys`, n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    `score` is 1 for a document with a phrase in place, else the largest share
    of a template found in a line or window, else 0. Null and empty texts have no words
    and no labels. Each row is judged by itself, so ids may be null or repeated;
    other columns are left out.
    """
    rule = rule or Rule()
    count = document_frequency(docs, rule)
    ordered = sorted(rule.vocabulary, key=lambda w: (count.get(w, 0), w))
    rarest = sorted({w for t, _ in rule.templates for w in _prefix(ordered, rule, t)})
    base = docs.select(*keys, "text", words(F.col("text")).alias("__words"))
    base = base.select(
        *keys,
        "text",
        F.size("__words").cast("bigint").alias("n_words"),
        F.arrays_overlap("__words", _strings(rarest)).alias("__some"),
        "__words",
        *[_places(F.col("__words"), p).alias(f"__p{i}") for i, (p, _) in enumerate(rule.phrases)],
    )
    line_words = lambda line: F.array_intersect(_strings(ordered), words(line))
    fewest = min(rule.least(t) for t, _ in rule.templates)
    blocks = F.filter(F.transform(F.split(F.col("text"), "\n"), line_words), lambda b: F.size(b) >= fewest)
    base = base.withColumn("__blocks", F.when(F.col("__some"), blocks).otherwise(F.array().cast("array<array<string>>")))
    held = F.array_intersect(_strings(ordered), F.col("__words"))
    base = base.withColumn("__held", F.when(F.col("__some"), held).otherwise(F.array().cast("array<string>")))
    base = base.select(
        "*",
        *[
            F.greatest(
                F.coalesce(F.array_max(F.transform("__blocks", _share_of(ordered, rule, t))), F.lit(0.0)),
                F.coalesce(_in_windows(F.col("__words"), F.col("__held"), ordered, rule, t), F.lit(0.0)),
            ).alias(f"__t{i}")
            for i, (t, _) in enumerate(rule.templates)
        ],
    )
    every = F.concat(*[F.col(f"__p{i}") for i in range(len(rule.phrases))])
    phrase_labels = [F.when(F.size(f"__p{i}") > 0, F.lit(x)) for i, (_, x) in enumerate(rule.phrases)]
    template_labels = [F.when(F.col(f"__t{i}") > 0, F.lit(x)) for i, (_, x) in enumerate(rule.templates)]
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
    best = F.greatest(*[F.col(f"__t{i}") for i in range(len(rule.templates))])
    return base.select(
        *keys,
        "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        joined(phrase_labels).alias("base_labels"),
        joined(phrase_labels + template_labels).alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def _prefix(ordered: list[str], rule: Rule, template: str) -> list[str]:
    own = set(template.split())
    row = [w for w in ordered if w in own]
    return row[: len(row) - rule.least(template) + 1]


def oracle(rule: Rule | None = None) -> str:
    """The scan in DuckDB SQL, by comparing every line with every template; it has no windows."""
    rule = rule or Rule()
    def split(text: str) -> str:
        low = f"translate({text}, '{_UPPER}', '{_LOWER}')"
        return f"list_filter(regexp_split_to_array({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    words_of = split("coalesce(text, '')")
    places = []
    for p, _ in rule.phrases:
        parts = p.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(parts))
        places.append(f"list_filter(range(0, greatest(len(w) - {len(parts) - 1}, 0)), lambda i: {same})")
    shares = []
    for t, _ in rule.templates:
        own = sorted(set(t.split()))
        listed = "[" + ", ".join(f"'{x}'" for x in own) + "]"
        shared = f"len(list_intersect({split('line')}, {listed}))"
        shares.append(f"coalesce(list_max(list_transform(lines, lambda line: CASE WHEN {shared} >= {rule.least(t)} THEN {shared} / {len(own)}.0::DOUBLE ELSE 0.0 END)), 0.0)")
    base_labels = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{x}' END" for i, (_, x) in enumerate(rule.phrases))
    more = ", ".join(f"CASE WHEN t{i} > 0 THEN '{x}' END" for i, (_, x) in enumerate(rule.templates))
    every = " || ".join(f"p{i}" for i in range(len(rule.phrases)))
    joined = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{x}], lambda z: z IS NOT NULL))), ','), '')"
    return f"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, {words_of} AS w FROM documents),
b AS (
  SELECT doc_id, len(w) AS n_words,
         {', '.join(f'{p} AS p{i}' for i, p in enumerate(places))},
         {', '.join(f'{s} AS t{i}' for i, s in enumerate(shares))}
  FROM a
), c AS (SELECT *, {every} AS places, greatest({', '.join(f't{i}' for i in range(len(shares)))}) AS best FROM b)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       {joined(base_labels)} AS base_labels, {joined(base_labels + ', ' + more)} AS labels,
       CASE WHEN len(places) > 0 THEN 1.0 ELSE best END::DOUBLE AS score
FROM c
"""
