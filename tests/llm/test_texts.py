"""Decontamination, pieces, language, line chunks, quality, archives, licences and the pipeline."""

import hashlib
import math
import random
import zlib

import brute
import corpus_pipeline
import public_tokenizers
import pytest
import xxhash
from oracle import connect, differences

from depthline.llm import decontaminate, language, licences, lines, pieces, quality, queries, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_spaced_seeds(spark, frame, mixed, small):
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    benchmark += [(900, "nine words stand here in a short benchmark item"), (901, None), (902, ""), (None, "no id")]
    rng = random.Random(3)
    planted = [(60_000, "before NINE words stand here in a short benchmark item after"), (60_001, "nine words stand here in a tall benchmark item")]
    for i in range(20):  # one word in eight replaced
        w = brute.WORD.findall(benchmark[i][1])
        for k in range(3, len(w), 8):
            w[k] = f"zz{rng.randrange(1000)}"
        planted.append((60_100 + i, "some words first " + " ".join(w) + " and last"))
    rows = [r for r in mixed if len(r[1] or "") < 20_000] + planted
    rule = decontaminate.Rule()
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    got = decontaminate.overlaps(frame(rows), items, rule).collect()
    want = brute.leaks(rows, [b for b in benchmark if b[0] is not None], rule.overlap, rule.percent)
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {(60_100 + i, benchmark[i][0]) for i in range(20)} <= want and (60_001, 900) in want
    in_blocks = decontaminate.overlaps(frame(rows), items, decontaminate.Rule(block_bytes=2000))
    assert sorted(map(str, in_blocks.collect())) == sorted(map(str, got))
    left = decontaminate.without_overlaps(frame(rows), items, rule)
    assert left.columns == frame(rows).columns
    assert left.count() == sum(1 for d, _ in rows if d not in {x for x, _ in want})
    assert decontaminate.overlaps(frame([]), items).count() == 0
    assert decontaminate.overlaps(frame(rows), items.limit(0)).count() == 0


def test_pieces_equal_the_library(spark, frame, mixed):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = mixed + [(80_000 + i, t) for i, t in enumerate([" ", "  a", "\n\n", "▁▁the▁", "<s></s>", " " * 90 + "x", "ab" * 300, "\x00a", "Ω≈ç√∫˜µ", "x" * 64, "x" * 65])]
    assert pieces.mismatches(frame(rows), MODEL, ["doc_id"]).count() == 0
    for r in pieces.encode(frame(rows[-40:]), MODEL, ["doc_id", "label"]).collect():
        assert r.n_tokens == len(r.ids) and r.decoded == library.decode(list(r.ids)) and r.label == "l"
    want = []
    for d, t in rows:
        ids = library.encode(t or "")
        text = library.decode(ids)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in pieces.encode_digests(frame(rows), MODEL, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.encode(frame([]), MODEL, ["doc_id"]).count() == 0


def test_pieces_report_a_difference(frame, monkeypatch):
    v = pieces.vocabulary(MODEL)
    assert v.decode([v.bytes[0xC3], v.ids["▁the"]]) == "� the"


def test_language_on_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = language.predicted(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    away = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in away) >= 0.95 * len(away)


def test_language_profiles_and_edges(spark, frame):
    texts = [("xx", "aab aab"), ("xx", "aab"), ("yy", "zzz"), (None, "q"), ("yy", None)]
    rule = language.Rule(top=5)
    learned = language.profiles(spark.createDataFrame(texts, "lang string, text string"), rule)
    places = {(r.lang, r.gram & (2**64 - 1)): r.place for r in learned.collect()}
    assert places["xx", ord("a")] == 0 and places["yy", ord("z")] == 0 and len([k for k in places if k[0] == "xx"]) == 5
    rows = [(1, None), (2, ""), (3, "123 --"), (4, "AAB"), (5, "zz"), (5, "zz"), (None, "zz")]
    got = sorted((str(r.doc_id), r.lang_pred) for r in language.identify(frame(rows), learned, rule).collect())
    assert got == sorted([("1", "und"), ("2", "und"), ("3", "und"), ("4", "xx"), ("5", "yy"), ("5", "yy"), ("None", "yy")])
    assert language.identify(frame(rows), learned.limit(0), rule).filter("lang_pred <> 'und'").count() == 0
    with pytest.raises(ValueError):
        language.identify(frame(rows), learned, language.Rule(most_languages=1))


def test_line_chunks(frame, documents):
    rng = random.Random(8)
    passage = [f"line {i} of a passage" for i in range(12)]
    rows = documents + [(95_000 + i, "\n".join([f"own {i}", *passage[rng.randrange(4) :], f"end {rng.random()}"])) for i in range(20)]
    rows += [(None, "\n".join(passage)), (96_000, None), (96_001, ""), (96_002, "\n\n\n\n\n\n"), (96_003, "\n\n\n\n\n\n"), (96_004, "a\n" * 20_000)]
    docs = frame(rows)
    got = {r.doc_id: r for r in lines.without_repeats(docs).collect()}
    con = connect("/root/testdata/sf0.001")
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows if r[0] is not None])
    for doc_id, n_lines, n_removed, digest in con.execute(lines.ORACLE).fetchall():
        r = got[doc_id]
        assert (r.n_lines, r.n_removed) == (n_lines, n_removed)
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == digest
    assert got[None].text == "\n".join(passage) and got[96_000].text is None and got[95_019].n_removed > 0
    assert got[95_019].label == "l" and got[95_019].hash == 3
    assert lines.without_repeats(frame([])).count() == 0
    twice = lines.without_repeats(frame([(1, "a\nb\nc\nd\ne\nf")] * 2), lines.Rule(every=2)).collect()
    assert [r.n_removed for r in twice] == [0, 0]


def _spark_hash(value, seed=42):
    data = value.encode() if isinstance(value, str) else (value % 2**64).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed % 2**64)


def test_quality_rules(spark, frame, mixed):
    rule = quality.Rule(buckets=512)
    rows = [r for r in mixed if r[0] != 90_012]
    trusted = {d for d, _ in rows if d is not None and d % 3 == 0}
    frames = spark.createDataFrame([(d,) for d in trusted] + [(None,)], "doc_id long")
    buckets = {}
    for k, (_, text) in enumerate(rows):
        h = [_spark_hash(w) for w in brute.WORD.findall(text or "")]
        pairs = [_spark_hash(b, _spark_hash(a)) for a, b in zip(h, h[1:])] + [_spark_hash(a) for a in h[-1:]]
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        buckets[k] = [signed(x) % rule.buckets for x in [*h, *pairs]]
    raw, good = [0] * rule.buckets, [0] * rule.buckets
    for k, (d, _) in enumerate(rows):
        for b in buckets[k]:
            raw[b] += 1
            good[b] += d in trusted
    added = rule.smoothing * rule.buckets
    ratio = [math.log((g + rule.smoothing) / (sum(good) + added)) - math.log((r + rule.smoothing) / (sum(raw) + added)) for g, r in zip(good, raw)]
    want = []
    for k, (d, text) in enumerate(rows):
        counts = brute.base_counts(text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        score = sum(ratio[b] for b in buckets[k]) / len(buckets[k]) if buckets[k] else 0.0
        want.append((str(d), *counts, failed, score))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    got = quality.scored(frame(rows), frames, rule).select(*names).collect()
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[1])), sorted(want)):
        assert (str(g[0]), *g[1:7]) == w[:7]
        assert g.score == pytest.approx(w[7], abs=1e-4)
        assert g.kept == (not g.base_failed and g.score >= rule.threshold)
    passed = quality.passing(frame(rows), frames, rule)
    assert passed.columns == frame(rows).columns
    assert passed.count() == sum(g.kept for g in got) and passed.filter("kept <> 'k'").count() == 0
    assert quality.scored(frame([]), frames, rule).count() == 0
    assert quality.scored(frame(rows), frames.limit(0), rule).count() == len(rows)


def test_archives(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"http://www.h{i % 3}.org:80/p{i % 7}?b=2&a=1", f"<p>{rng.randrange(25)}</p>") for i in range(120)]
    rows += [(500, None, None), (501, "http://A.b/ \r\nx", ""), (502, "http://[bad", "x\r\n\r\nWARC/1.1\r\n\r\né"), (503, "http://q/", "x\r\n\r\nWARC/1.1\r\n\r\né"), (504, "http://q/", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(4)
    got = warc.archived(pages, warc.Rule(per_file=20), str(tmp_path / "a")).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert {tuple(r[c] for c in columns) for r in got} == brute.pages([(p, h) for p, _, h in rows]) and len(got) == len(rows)
    order = [(r.url_key, r.captured, r.page_id) for r in sorted(got, key=lambda r: (r.capture_range, r.capture_no))]
    assert order == sorted(order)
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("part-*")))
    records = list(warc.parse(data))
    assert len(records) == len(rows) and sum(h["WARC-Type"] == "revisit" for h, _ in records) == sum(r.record_type == "revisit" for r in got)
    large = warc.archived(pages, warc.Rule(least_bytes=10), str(tmp_path / "b")).filter("payload_bytes < 10 and record_type = 'revisit'")
    assert large.count() == 0
    repeated = warc.archived(pages.unionByName(pages.filter("page_id = 7")).unionByName(pages.filter("page_id = 7").selectExpr("null page_id", "url", "html", "record_type")))
    assert repeated.count() == len(rows) + 2
    assert warc.archived(pages.limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in range(10):
        runs = [sorted(((n, rng.choice("abc"), str(rng.randrange(3)), rng.randrange(9)) for _ in range(rng.randrange(6))), key=warc._place) for n in range(k)]
        merged = [warc._place(x) for x in warc.LoserTree(runs)]
        assert merged == sorted(warc._place(x) for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert warc.url_key("https://x.org:8443") == "org,x:8443)/"


def test_licences(spark, frame, mixed):
    rows = mixed + [
        (97_000, "All rights, RESERVED all rights reserved"),
        (97_001, "text\nReleased under the MIT License.\nCC-BY cc by"),
        (97_002, "Released under license"),
        (97_003, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files"),
        (97_004, "GNU General Public License"),
    ]
    docs = frame(rows)
    con = connect("/root/testdata/sf0.001")
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(d, (t or "").replace("\x00", " ")) for d, t in rows])
    assert differences(licences.scan(docs), con, licences.oracle()) is None
    labels = {r.doc_id: r.labels for r in licences.scan(docs).collect()}
    assert labels[97_000] == "reserved" and labels[97_001] == "cc-by,mit" and labels[97_002] == "" and labels[97_003] == "mit" and labels[97_004] == "gpl"
    assert licences.scan(frame([])).count() == 0


def test_pipeline_by_stages(spark, small):
    """Each stage on what the one before kept, against the plain versions."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "encoding"]
    trusted = queries.table(spark, small, "labels").filter("quality = 1").select("doc_id")
    kept = {r.doc_id for r in quality.scored(docs, trusted).select("doc_id", "kept").collect() if r.kept}
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after[name] = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(list(after[name].values()), docs.schema)
    assert set(after["quality_rules"]) == kept and all(after["quality_rules"][d] == rows[d] for d in kept)
    assert set(after["line_dedup"]) == kept
    components = brute.components([(d, r.text) for d, r in after["line_dedup"].items()], 5, 80)
    assert set(after["near_dedup"]) == {d for d, (_, c) in components.items() if c == d}
    benchmark = [(r.item_id, r.text) for r in queries.table(spark, small, "benchmark").collect()]
    leaked = {d for d, _ in brute.leaks([(d, r.text) for d, r in after["near_dedup"].items()], benchmark, 13, 80)}
    assert set(after["decontamination"]) == set(after["near_dedup"]) - leaked
    last = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in last} == set(after["decontamination"])
    for r in last:
        assert r.decoded == after["decontamination"][r.doc_id].text and r.n_tokens == len(r.ids)


def test_entry_has_the_queries():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert {"op7_line_chunks", "op9_warc", "op10_licences", "op11_boundaries", "op13_zfast_trie"} <= set(entry.oracle_sql())
