"""Short repeated passages, which cuts alone miss."""

import random

import corpus_pipeline

from depthline.llm import lines


def _without_pairs(rows):
    """Plain version: places of lines in a pair of neighbours that stands earlier and shares no line with it."""
    first, gone = {}, set()
    for d, t in sorted(rows):
        ls = t.split("\n")
        for i, p in enumerate(zip(ls, ls[1:])):
            if not "".join(p).strip():
                continue
            at = first.setdefault(p, (d, i))
            if at[0] != d or i - at[1] >= 2:
                gone |= {(d, i), (d, i + 1)}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}


def test_pipeline_removes_short_passages_whole(spark, frame, small):
    rng = random.Random(12)
    passages = [[" ".join(f"w{rng.randrange(9999)}" for _ in range(30)) for _ in range(n)] for n in (2, 2, 2, 3, 3, 4, 5, 8)]
    rows = []
    for k, p in enumerate(passages):
        for copy in range(3):
            rows.append((100 * k + copy, "\n".join([f"head {k} {copy}", *p, f"tail {k} {copy}"])))
    docs = frame(rows).select("doc_id", "text").selectExpr("*", "'en' lang", "'s' source", "length(text) + 0L n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, small).collect()}
    for k, p in enumerate(passages):
        assert got[100 * k] == rows[3 * k][1]
        for copy in (1, 2):
            assert got[100 * k + copy] == f"head {k} {copy}\ntail {k} {copy}"


def test_pairs_by_a_plain_version(frame):
    rng = random.Random(13)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "d e", "f"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100, "z\nz\nz"), (101, "y\ny\ny\ny"), (102, "p\n\n\nq"), (103, "r\n\n\n\ns"), (104, "q\nq\n" * 3000)]
    # Cuts that never fall leave whole texts as chunks, so that pairs alone decide.
    rule = lines.Rule(every=2**31, pairs=True, fewest=10**6)
    got = lines.without_repeats(frame(rows), rule).collect()
    want = _without_pairs(rows)
    for r in got:
        assert r.text == want[r.doc_id], r.doc_id
    assert want[100] == "z\nz\nz" and want[101] == "y\ny" and want[103] == "r\n\n\n\ns"
