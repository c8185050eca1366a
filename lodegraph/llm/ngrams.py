"""Hashed n-grams of whole texts: byte 4-grams, words and pairs of words, and trigrams of word shapes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lodegraph.llm.shingles import mix, text_buffer, word_hashes

SHAPES = 32


def byte_grams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte 4-grams and where each document's begin. A text of fewer bytes has none."""
    n = len(data)
    if n < 4:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    wide = data.astype(np.uint32)
    key = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    bucket = (key * np.uint32(2654435769)) ^ (key * np.uint32(2246822519) >> np.uint32(15))
    bucket = (bucket * np.uint32(3266489917)) >> np.uint32(32 - bits)
    inside = np.ones(len(bucket), dtype=bool)
    for k in (1, 2, 3):
        at = offsets[1:-1] - k
        at = at[(at >= 0) & (at < len(bucket))]
        inside[at] = False
    sizes = np.maximum(np.diff(offsets) - 3, 0)
    # a document shorter than three bytes also cuts what its neighbours span, which `inside` has marked
    return bucket[inside], np.r_[0, np.cumsum(sizes)]


def word_shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: whether one of the three words before is the same, the kind of its first and last byte; bounds per document."""
    words, bounds = word_hashes(data, offsets, lower=False)
    if not len(words):
        return np.zeros(0, np.uint32), bounds
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    again = np.zeros(len(words), dtype=bool)
    for k in (1, 2, 3):
        if len(words) > k:
            again[k:] |= (words[k:] == words[:-k]) & (owner[k:] == owner[:-k])
    kind = np.full(256, 3, dtype=np.uint32)
    kind[ord("a") : ord("z") + 1] = 0
    kind[128:] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[[ord(c) for c in ".,"]] = 2
    separator = np.zeros(256, dtype=bool)
    separator[list(b" \t\n\v\f\r")] = True
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] |= inside[inner]
    last[inner - 1] |= inside[inner - 1]
    return again.astype(np.uint32) * np.uint32(16) + kind[data[first]] * np.uint32(4) + kind[data[last]], bounds


def shape_grams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of trigrams of word shapes, padded at the start of each document, so there is one a word; bounds per document."""
    shapes, bounds = word_shapes(*text_buffer(texts))
    n = len(shapes)
    if not n:
        return shapes, bounds
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    before, earlier = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    before[1:] = shapes[:-1]
    earlier[2:] = shapes[:-2]
    before[place < 1] = SHAPES - 1
    earlier[place < 2] = SHAPES - 1
    gram = (earlier * np.uint32(SHAPES) + before) * np.uint32(SHAPES) + shapes
    return (gram * np.uint32(2654435769)) >> np.uint32(32 - bits), bounds


def word_grams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of lower-case words, and of each with the word before it, the two in turn; bounds per document. A document's first word has a pair with nothing."""
    words, bounds = word_hashes(*text_buffer(texts), lower=True)
    before = np.zeros(len(words), np.uint64)
    before[1:] = words[:-1]
    before[bounds[:-1][bounds[:-1] < len(words)]] = 0
    out = np.empty(2 * len(words), np.uint64)
    out[0::2] = mix(words + np.uint64(3))
    out[1::2] = mix(mix(before + np.uint64(5)) ^ words)
    return (out >> np.uint64(64 - bits)).astype(np.uint32), 2 * bounds


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each document's integers, exact, so that equal documents have equal sums whatever stands beside them."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[bounds[1:]] - total[bounds[:-1]]
