import random

import pytest
from pyspark.sql import functions as F

from depthline.llm import queries, wordbpe

ALPHABET = list("abcABC '’sStTlLdDrRveEmM019 \t\n.,!?-_<|>éÉñÑßİıσΣς①²½漢字かな한글") + [
    "İ", "́", "é", " ", "　", "\x85", "\x1c", "\x00", "ﬁ", "\U0001f642", "\U00010d50", "Ᲊ",
    "Ɤ", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "'re", "'ll", "hello", "world", "don't",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_model())


def encoded(v, text):
    return [i for w in v.words(text) for i in v.encode_word(w)]


def test_random_texts_against_the_library(library):
    v = wordbpe.vocabulary(queries.word_model())
    random.seed(4)
    texts = ["".join(random.choices(ALPHABET, k=random.randint(0, 40))) for _ in range(5000)]
    texts += ["a" * 3000, "".join(random.choices("etaoin", k=3000)), "\U00010d50" * 60]
    for text in texts:
        assert encoded(v, text) == library.encode(text, add_special_tokens=False).ids, text


def test_kinds_of_all_code_points(library):
    """Letters, numbers, spaces and the rest, and lower cases, are the library's for every code point."""
    v = wordbpe.vocabulary(queries.word_model())
    for first in range(0, 0x110000, 4096):
        points = [chr(c) for c in range(first, first + 4096) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"a{c}a {c}{c}" for c in points)
        want = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        letters = wordbpe.byte_alphabet()
        assert ["".join(letters[b] for b in w.encode()) for w in v.words(text)] == want


def check(rows, out, library):
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in out) == want
    for r in out:
        assert r.decoded == library.decode(list(r.ids), skip_special_tokens=False) and r.n_tokens == len(r.ids)


def test_texts_and_edges_against_the_library(frame, mixed, library):
    rows = mixed + [(92_000, "x <|endoftext|> Y"), (92_001, "　"), (92_002, "word " * 60_000)]
    check(rows, wordbpe.encode(frame(rows), queries.word_model(), ["doc_id"]).collect(), library)


def test_blocks_do_not_change_anything(frame, mixed, library, monkeypatch):
    monkeypatch.setattr(wordbpe, "BLOCK_CHARS", 500)
    index, texts = {}, [t or "" for _, t in mixed]
    assert len(texts) > len(index)
    check(mixed, wordbpe.encode(frame(mixed), queries.word_model(), ["doc_id"]).collect(), library)


def test_digests_are_those_of_the_ids(frame, mixed):
    docs = frame(mixed)
    whole = wordbpe.encode(docs, queries.word_model(), ["doc_id", "label"])
    plain = whole.select(
        "doc_id", "label", "n_tokens",
        F.sha2(F.unhex(F.array_join(F.transform("ids", lambda i: F.concat(
            F.lpad(F.hex(i % 256), 2, "0"), F.lpad(F.hex((i / 256).cast("int") % 256), 2, "0"), F.lit("0000"))), "")), 256).alias("a"),
        F.sha2("decoded", 256).alias("b"),
    )
    got = wordbpe.encode_digests(docs, queries.word_model(), ["doc_id", "label"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, plain.collect())))


def test_decoding_lists_of_ids(spark, library):
    random.seed(6)
    lists = [[random.randrange(49_408) for _ in range(random.randrange(30))] for _ in range(200)]
    lists += [[], None, [None, 5, None], [49_406, 0, 49_407], [60_000, 7, -3], lists[0], lists[0]]
    df = spark.createDataFrame(list(enumerate(lists)), "key int, ids array<int>").repartition(3)
    for r in wordbpe.decode(df.withColumn("block", F.lit(1)), queries.word_model(), ["key", "block"]).collect():
        known = [i for i in lists[r.key] or [] if i is not None and 0 <= i < 49_408]
        assert r.decoded == library.decode(known, skip_special_tokens=False) and r.block == 1


def test_an_empty_table_and_an_unknown_vocabulary(frame, tmp_path):
    assert wordbpe.encode(frame([(1, "x")]).limit(0), queries.word_model(), ["doc_id"]).collect() == []
    import json

    spec = json.load(open(queries.word_model(), encoding="utf-8"))
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:1]
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        wordbpe.Vocabulary(str(tmp_path / "other.json"))
