"""SuperMinHash signatures of shingle sets, for whole blocks of texts at a time."""

from __future__ import annotations

import numpy as np

from depthline.llm import kernels as K

U = np.uint64
_LOW32 = U(0xFFFFFFFF)


def super_min_hash(elements: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Signatures (texts x `size`, 64-bit): the least rank that each slot gets from any element.

    Every element walks a random permutation of the slots (seeded by itself); at
    its step `j` it offers the value `j + r`, with `r` random below 1, to the
    slot that stands at `j`. All elements of a text take a step together: as
    every value of step `j` is below those of later steps, a text stops after
    the step that fills its last slot. Repeated elements change nothing. A text
    without elements keeps the largest value in every slot.
    """
    n_texts = len(bounds) - 1
    empty = U(2**64 - 1)
    out = np.full(n_texts * size, empty, U)
    text = np.repeat(np.arange(n_texts), np.diff(bounds))
    element = elements
    steps: np.ndarray | None = None
    for j in range(size):
        draw = K.mix(element + U((0x9E3779B97F4A7C15 * (j + 1)) % 2**64))
        at = (((draw & _LOW32) * U(size - j)) >> U(32)).astype(np.int64) + j
        if steps is None:
            slot = at
        else:
            every = np.arange(len(element))
            slot = steps[every, at].astype(np.int64)
            steps[every, at] = steps[every, j]
            steps[every, j] = slot
        np.minimum.at(out, text * size + slot, (U(j) << U(32)) | (draw >> U(32)))
        open_texts = (out.reshape(n_texts, size) == empty).any(axis=1)
        left = open_texts[text]
        if not left.any():
            break
        first = at[left] if steps is None else None
        text, element = text[left], element[left]
        if steps is None:
            steps = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(element), 1))
            every = np.arange(len(element))
            steps[every, first] = 0
            steps[every, 0] = first
        else:
            steps = steps[left]
    return out.reshape(n_texts, size)


def short_form(signatures: np.ndarray) -> np.ndarray:
    """Two bytes for each slot; unequal values agree by chance once in 65,536 times."""
    return (K.mix(signatures.ravel()) >> U(48)).astype(np.uint16).reshape(signatures.shape)


def set_digests(elements: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit digests of each text's set of elements."""
    n = len(bounds) - 1
    size, one, two = np.zeros(n, np.int64), np.zeros(n, U), np.zeros(n, U)
    for i in range(n):
        own = np.unique(elements[bounds[i] : bounds[i + 1]])
        size[i] = len(own)
        one[i] = own.sum(dtype=U)
        two[i] = np.bitwise_xor.reduce(K.mix(own ^ U(0xD6E8FEB86659FD93))) if len(own) else U(0)
    return size, one, two
