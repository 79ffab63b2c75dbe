"""SuperMinHash near duplicates, components, and repeated byte and word windows."""

import random

import brute
import numpy as np
import pytest

from depthline.llm import anchors, graph, kernels, minhash, sais, signatures, substrings, suffix


def test_superminhash_estimates_similarity():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    for n in (8, 60, 900):
        a = [rng.choice(vocabulary) for _ in range(n)]
        b = list(a)
        for _ in range(max(1, n // 40)):
            b[rng.randrange(n)] = rng.choice(vocabulary)
        import pyarrow as pa

        buf, off = kernels.text_bytes(pa.array([" ".join(a), " ".join(b), "", None]))
        start, end, bounds = kernels.words(buf, off)
        elements, at = kernels.shingles(kernels.span_hash(buf, start, end), bounds, 3)
        sig = signatures.short_form(signatures.super_min_hash(elements, at, 256))
        x, y = brute.shingles(" ".join(a), 3), brute.shingles(" ".join(b), 3)
        assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.15
        assert (sig[2] == sig[3]).all() and at[2] == at[4]


def test_superminhash_by_element():
    """The signature is that of elements walked one after the other, with early stopping left out."""
    rng = np.random.RandomState(5)
    size = 16
    elements = rng.randint(0, 2**62, 40).astype(np.uint64)
    want = [2**64] * size
    for e in elements.tolist():
        order = list(range(size))
        for j in range(size):
            draw = int(kernels.mix(np.array([(e + 0x9E3779B97F4A7C15 * (j + 1)) % 2**64], np.uint64))[0])
            at = ((draw & 0xFFFFFFFF) * (size - j) >> 32) + j
            order[j], order[at] = order[at], order[j]
            want[order[j]] = min(want[order[j]], (j << 32) | (draw >> 32))
    assert signatures.super_min_hash(elements, np.array([0, 40]), size)[0].tolist() == want


@pytest.mark.parametrize("rule", [minhash.Rule(words=3, percent=85), minhash.Rule()])
def test_near_duplicates(spark, frame, mixed, rule):
    rng = random.Random(4)
    base = [f"t{rng.randrange(500)}" for _ in range(120)]
    family = []
    for i in range(40):  # copies that share much, at different distances
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10_000)}"
        family.append((50_000 + i, " ".join(w)))
    rows = mixed + family
    want = brute.components(rows, rule.words, rule.percent)
    got = minhash.near_duplicates(frame(rows), rule).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_nothing(frame):
    assert minhash.near_duplicates(frame([]), minhash.Rule()).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(900, 901 + i) for i in range(60)]
    links += [(5, None), (7, 7), (101, 100)]
    root = {x: x for a, b in links if b is not None for x in (a, b)}
    for _ in range(200):
        for a, b in links:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    linked = {x for a, b in links if b is not None and a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.RandomState(0)
    for _ in range(400):
        n = rng.randint(1, 70)
        s = rng.randint(0, rng.choice([1, 2, 3, 6, 60]), n)
        if rng.rand() < 0.3:
            s = np.tile(s[: max(1, n // 4)], 4)
        row = s.tolist()
        want = sorted(range(len(row)), key=lambda i: row[i:])
        sa = sais.suffix_array(s)
        assert sa.tolist() == want
        lcp = sais.permuted_lcp(s, sa)
        for a, b in zip(want, want[1:]):
            k = 0
            while max(a, b) + k < len(row) and row[a + k] == row[b + k]:
                k += 1
            assert lcp[b] == k
    assert len(sais.suffix_array(np.zeros(0, np.int64))) == 0


def _shared(rows):
    """Passages that overlap at many offsets, and a run of one letter."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcde ") for _ in range(400))
    out = [(70_000 + i, text[rng.randrange(200) :][: rng.randrange(40, 200)] + " tail%d" % i) for i in range(30)]
    words = [f"v{rng.randrange(40)}" for _ in range(300)]
    out += [(71_000 + i, " ".join(words[(a := rng.randrange(150)) : a + rng.randrange(20, 120)])) for i in range(30)]
    return rows + out


@pytest.mark.parametrize("heavy", [200_000, 12])
def test_byte_repeats(frame, mixed, heavy):
    rows = [r for r in _shared(mixed) if r[0] != 90_012]
    rule = anchors.Rule(window=50, gram=16, distinct_docs=True, heavy=heavy, batch_bytes=60_000)
    got = suffix.without_repeats(frame(rows), rule, digests=True).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute.byte_repeats(rows, 50), key=key)


def test_byte_repeats_keep_bytes_and_nothing(frame):
    assert suffix.without_repeats(frame([])).count() == 0
    got = {r.doc_id: bytes(r.kept) for r in suffix.without_repeats(frame([(1, "é" * 30), (2, "é" * 30 + "z"), (2, "é" * 30 + "z")])).collect()}
    assert got == {1: "é".encode() * 30, 2: b"z"}


@pytest.mark.parametrize("heavy", [200_000, 10])
def test_word_repeats(frame, mixed, heavy):
    rows = _shared(mixed)
    rule = anchors.Rule(window=35, gram=8, distinct_docs=False, heavy=heavy, batch_bytes=60_000)
    got = substrings.without_repeats(frame(rows), rule, digests=True).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute.word_repeats(rows, 35), key=key)


def test_word_repeats_of_nothing(frame):
    assert substrings.without_repeats(frame([])).count() == 0
    assert substrings.without_repeats(frame([(1, "a b")])).first().kept == "a b"


def test_lists_that_grow_are_never_broadcast(spark):
    """A small table has the plan of a large one, so its shuffles tell what a large one's will be."""
    from depthline.llm import minhash

    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y z u v w")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    verified = minhash._verified(pairs, docs, minhash.Rule())
    found = minhash.near_duplicates(docs)
    for df in (verified, found):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 3}


def test_a_shard_is_worked_on_in_parts():
    """Parts by key give the spans that the whole shard does, and no part is much larger than asked for."""
    import zstandard

    from depthline.llm import anchors, suffix

    rng = np.random.default_rng(4)
    passages = [rng.integers(97, 123, 120).astype(np.uint8).tobytes() for _ in range(40)]
    rows = []
    for doc in range(1, 30):
        keys = rng.choice(40, 12, replace=False).astype(np.int64)
        texts = [passages[k][int(rng.integers(0, 5)) :] for k in keys]
        lists = {"keys": keys, "docs": np.full(12, doc), "starts": np.arange(12) * 1000, "sizes": np.array([len(x) for x in texts], np.int32)}
        rows.append({"shard": 0, **{c: v.tobytes() for c, v in lists.items()}, "content": zstandard.ZstdCompressor().compress(b"".join(texts))})

    def spans(part_bytes):
        out = {}
        for doc, pairs in suffix._shard_spans(list(rows), 50, part_bytes):
            out.setdefault(doc, []).append(np.frombuffer(pairs, np.int64).reshape(-1, 2))
        merged = {d: np.concatenate(x) for d, x in out.items()}
        return {d: np.stack(anchors.merged_spans(np.zeros(len(x), np.int64), x[:, 0], x[:, 1])[1:]).tolist() for d, x in merged.items()}

    assert spans(10**9) == spans(4000) and spans(10**9)
    sizes = [len(part[4]) for part in suffix._parts(list(rows), 4000)]
    assert len(sizes) > 5 and max(sizes) < 16_000


@pytest.mark.parametrize("operator", [suffix, substrings])
def test_results_return_to_documents_as_mail(spark, operator):
    """Shards send a row to a bucket of documents, not to each document, and a document gets one row."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [(i, " ".join(words[(a := 20 * rng.randrange(100)) : a + 400])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rule, split = operator.RULE, operator._split(operator.RULE)
    shared = anchors.shared_anchors(docs, rule, split)
    assert 0 < shared.count() <= shards * shards < len(rows)
    spans = operator.repeated_spans(docs)
    assert spans.count() == spans.select("doc_id").distinct().count() > 250
    pack = suffix._segments if operator is suffix else substrings._contexts
    entries = pack(anchors.known_texts(docs, shared), rule, {}, shards)
    assert 0 < operator._spans(entries, rule, shards).count() <= shards * shards


def test_an_anchor_with_much_content_never_makes_a_large_array(monkeypatch):
    """Contents of one key go to arrays of about the size asked for, and their spans stay the same."""
    rng = np.random.default_rng(7)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    mark, heads, tails = b"the same anchor.", [letters(34) for _ in range(60)], [letters(34) for _ in range(60)]
    texts = [heads[rng.integers(60)][rng.integers(20) :] + mark + tails[rng.integers(60)] for _ in range(600)]
    texts += [mark + b"Thinwhen, " * int(rng.integers(8, 300)) for _ in range(60)]
    texts += [b"z" * int(rng.integers(50, 1500)) for _ in range(30)]
    docs = rng.integers(0, 500, len(texts))
    size = np.array([len(x) for x in texts])
    content = np.frombuffer(b"".join(texts), np.uint8)
    seen = []
    array = suffix.sais.suffix_array
    monkeypatch.setattr(suffix.sais, "suffix_array", lambda s, n=None: seen.append(len(s)) or array(s, n))

    def spans(array_bytes):
        monkeypatch.setattr(suffix, "ARRAY_BYTES", array_bytes)
        monkeypatch.setattr(suffix, "PIECE", 100)
        seen.clear()
        found = list(suffix._part_spans(np.zeros(len(docs), np.int64), docs, np.arange(len(docs)) * 10_000, size, content, 50))
        pairs = [np.frombuffer(x, np.int64).reshape(-1, 2) for _, x in found]
        doc = np.repeat([d for d, _ in found], [len(x) for x in pairs])
        return [x.tolist() for x in anchors.merged_spans(doc, *np.concatenate(pairs).T)], max(seen)

    whole, one = spans(10**9)
    cut, largest = spans(4000)
    assert cut == whole and one > 100_000 and largest < 10_000
    least, expected = {}, set()
    for x, d in zip(texts, docs.tolist()):
        for i in range(len(x) - 49):
            least[x[i : i + 50]] = min(d, least.get(x[i : i + 50], d))
    for k, (x, d) in enumerate(zip(texts, docs.tolist())):
        expected |= {(d, 10_000 * k + j) for i in range(len(x) - 49) if least[x[i : i + 50]] < d for j in range(i, i + 50)}
    assert {(d, j) for d, a, b in zip(*whole) for j in range(a, b)} == expected


@pytest.mark.parametrize("operator", [suffix, substrings])
def test_shards_follow_the_texts(spark, frame, mixed, monkeypatch, operator):
    """There are as many shards as the texts need, a task has one, and results don't depend on their number."""
    docs = frame([r for r in _shared(mixed) if r[0] is not None])
    key = lambda r: (r[0], r[1])
    expected = sorted(map(tuple, operator.without_repeats(docs, digests=True).collect()), key=key)
    monkeypatch.setattr(anchors, "SHARD_BYTES", 40_000)
    text = docs.selectExpr("sum(octet_length(text))").first()[0]
    shards = anchors.shards_for(docs)
    assert shards == -(-text // 40_000) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(4 * shards).selectExpr(f"id % {shards} AS shard")
    held = anchors.dealt(rows, shards).selectExpr("shard", "spark_partition_id() AS p").distinct()
    assert held.count() == held.select("p").distinct().count() == shards
    assert sorted(map(tuple, operator.without_repeats(docs, digests=True).collect()), key=key) == expected


def test_parts_of_a_heavy_anchor_are_dealt_by_windows(spark):
    """An entry has up to 35 windows, so that many more parts are needed to hold no more windows than a light anchor has entries."""
    shared = spark.createDataFrame([(None, [5, 6], [1000, 99])], "bucket int, heavy array<int>, weights array<bigint>")
    assert anchors.heavy_anchors(shared, anchors.Rule(50, 16, True, heavy=100)) == {5: 351}
