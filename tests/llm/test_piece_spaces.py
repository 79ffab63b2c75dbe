"""Texts that mix spaces and literal U+2581, which are one symbol."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from depthline.llm import kernels, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_mixed_spaces_equal_the_library(frame):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(15)
    texts = ["a▁ 1", "a▁ b", "a▁ \n", "▁ ▁", " ▁a", "▁", "a▁", "▂ ▁ █", "é▁ ▁\t▁ x", "▁ " * 50 + "x"]
    texts += ["".join(rng.choice("ab1é█ ▁▁\n\t ") for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    v = pieces.vocabulary(MODEL)
    ids, bounds = v.encode(*kernels.text_bytes(pa.array(texts)))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert np.array(ids[a:b]).tolist() == library.encode(t), t
    assert pieces.mismatches(frame(list(enumerate(texts))), MODEL, ["doc_id"]).count() == 0
