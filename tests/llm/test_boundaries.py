import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthline.llm import boundaries as B

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, rule=B.Rule()):
    text = text or ""
    tokens = list(text) if rule.unit == "char" else TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in rule.markers) or h[2] % 100 >= rule.plain_from:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    p, s, m = rule.markers
    if h[3] % 100 < rule.spm_below:
        return n, "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return n, "psm", len(pre), len(mid), p + pre + s + suf + m + mid


EXTRA = [
    (91_000 + i, t)
    for i, t in enumerate(
        ["a <P> marker", "nearly <S <M", "<", "ends with space ", "\n", " lead", "é", "日本 語\U0001f600 z ", "<P", "x<S>y"] * 6
    )
]


@pytest.mark.parametrize("rule", [B.Rule(), B.Rule(plain_from=100), B.Rule(unit="char", plain_from=100, spm_below=40, seed=7)])
def test_every_form_against_plain_slices(frame, mixed, rule):
    rows = mixed + EXTRA
    out = B.transform(frame(rows), rule).withColumn("whole", B.restored(F.col("output"), F.col("form"), rule)).collect()
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.whole) for r in out)
    want = sorted((str(i), *made, t or "") for i, t in rows for made in [plainly(i, t, rule)])
    assert list(map(str, got)) == list(map(str, want))


def test_a_very_long_text_and_an_empty_table(spark, frame):
    text = "word and  more\n" * 200_000
    row = B.transform(frame([(5, text)]), B.Rule(plain_from=100)).first()
    assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == plainly(5, text, B.Rule(plain_from=100))
    assert B.transform(frame([(1, "x")]).limit(0)).collect() == []


@pytest.mark.parametrize(
    "offsets, kind",
    [
        (np.arange(0, 65_536, 977), B.ArrayContainer),
        (np.arange(0, 65_536, 5), B.BitmapContainer),
        (np.arange(100, 60_000), B.RunContainer),
    ],
)
def test_each_container_selects(offsets, kind):
    held = B.container(offsets.astype(np.uint16))
    assert isinstance(held, kind)
    assert np.array_equal(held.select(np.arange(len(offsets))), offsets)


def test_a_set_of_several_containers():
    rng = np.random.default_rng(0)
    parts = [rng.choice(65_536, 30, False), np.arange(65_536), 65_536 + rng.choice(65_536, 9000, False), [900_000], 10**9 + np.arange(7)]
    offsets = np.unique(np.concatenate(parts))
    held = B.BoundarySet(offsets)
    assert len({type(c) for c in held.containers}) == 3
    ranks = rng.permutation(len(offsets))
    assert np.array_equal(held.select(ranks), offsets[ranks])
