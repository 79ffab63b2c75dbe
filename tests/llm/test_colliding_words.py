"""Words that collide under any polynomial hash modulo a power of two, in all operators that hash spans."""

import brute
import pytest

from depthline.llm import minhash, pieces, queries, substrings, suffix


def turned(n: int) -> tuple[str, str]:
    """The Thue-Morse word of 2^n letters, and the same with its letters exchanged."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


ONE, OTHER = turned(10)


def test_near_duplicates(frame):
    rows = [(1, ONE), (2, OTHER), (3, f"{ONE} {OTHER}"), (4, f"{OTHER} {ONE}"), (5, " ".join(turned(11)))]
    want = brute.components(rows, 3, 85)
    for r in minhash.near_duplicates(frame(rows), minhash.Rule(words=3, percent=85)).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_byte_repeats(frame):
    rows = [(1, ONE), (2, OTHER), (3, turned(11)[0]), (4, turned(11)[1])]
    got = suffix.without_repeats(frame(rows), digests=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute.byte_repeats(rows, 50)


def test_word_repeats(frame):
    around = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join([*around, ONE, *around[::-1]])), (2, " ".join([*around, OTHER, *around[::-1]]))]
    # Words as letters: the order of two words follows the Thue-Morse word.
    rows += [(3 + k, " ".join({"a": "left", "b": "right"}[c] for c in w)) for k, w in enumerate(turned(10))]
    got = substrings.without_repeats(frame(rows), digests=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute.word_repeats(rows, 35)


def test_pieces(frame):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    rows = [(1, f"{ONE} {OTHER}"), (2, f"{OTHER}\n{ONE} {OTHER}")]
    for r in pieces.encode(frame(rows), queries.piece_model(), ["doc_id"]).collect():
        assert list(r.ids) == library.encode(dict(rows)[r.doc_id])
