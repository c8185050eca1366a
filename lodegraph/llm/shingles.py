"""Vectorised word and shingle hashing on Arrow string buffers.

Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR.
All separators are ASCII, so UTF-8 text can be cut bytewise. A word's hash is a
polynomial in its bytes modulo 2**64 followed by a mixing step; a shingle's hash
is a polynomial in its words' hashes, mixed again. Equal word sequences always
have equal hashes; different ones collide with chance about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time, which bounds the temporaries to some 40 times as much.
SLICE_BYTES = 1 << 19
SEPARATORS = b" \t\n\v\f\r"

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_tables(lower: bool) -> tuple[np.ndarray, np.ndarray]:
    values = np.arange(256, dtype=np.uint64)
    if lower:
        values[65:91] += _U(32)
    separator = np.zeros(256, dtype=bool)
    separator[list(SEPARATORS)] = True
    return mix(values + _U(1)), separator


_TABLES = {lower: _byte_tables(lower) for lower in (False, True)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, separator: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE_BYTES that end at a separator or at the end."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE_BYTES)
        while end < n:
            stop = min(n, end + SLICE_BYTES)
            found = np.flatnonzero(separator[data[end:stop]])
            if len(found):
                end += int(found[0])
                break
            end = stop
        yield at, end
        at = end


def letters_only() -> np.ndarray:
    """For `word_hashes`: all ASCII but letters separates."""
    out = np.ones(256, dtype=bool)
    out[128:] = False
    out[ord("A") : ord("Z") + 1] = False
    out[ord("a") : ord("z") + 1] = False
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, separator: np.ndarray | None = None, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each document where its words start (one more entry than documents).

    `separator` tells for each byte whether it parts words; `prefix` hashes that many first bytes only.
    """
    values, usual = _TABLES[lower]
    separator = usual if separator is None else separator
    hashes, starts_at = [], []
    edges = np.asarray(offsets, dtype=np.int64)
    for lo, hi in _cuts(data, separator):
        piece = data[lo:hi]
        inside = ~separator[piece]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first, last = np.searchsorted(edges, (lo, hi), side="left")
        own = edges[first:last]
        own = own[own < hi] - lo
        begins[own] |= inside[own]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        index = np.arange(len(piece), dtype=np.int32)
        owner = np.cumsum(begins, dtype=np.int32) - 1
        within = index - starts[np.maximum(owner, 0)].astype(np.int32)
        within[~inside] = 0
        product = values[piece] * powers(_MUL, int(within.max()) + 1)[within]
        product[~inside] = 0
        if prefix:
            product[within >= prefix] = 0
        hashes.append(mix(np.add.reduceat(product, starts)))
        starts_at.append(starts + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    at = np.concatenate(starts_at)
    return np.concatenate(hashes), np.searchsorted(at, edges, side="left")


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document.

    With fewer words than `size` the whole sequence is the one shingle; a document
    without words has an empty set.
    """
    n = len(words)
    weights = powers(_STEP, size)
    rolled = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for k in range(size if len(rolled) else 0):
        rolled += words[k : k + len(rolled)] * weights[k]
    rolled = mix(rolled + _U(size))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) > 1 else own)
        elif b > a:
            whole = (words[a:b] * weights[: b - a]).sum(dtype=np.uint64)
            out.append(mix(np.array([whole + _U(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of `count` universal hash functions modulo 2**64."""
    state = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * _MUL + _U(seed))
    return state[:count] | _U(1), state[count:]


def minhash(sets: list[np.ndarray], multipliers: np.ndarray, addends: np.ndarray, bits: int = 32) -> np.ndarray:
    """Signature matrix (documents by permutations): the least value of the high bits of a*x+b over the set.

    An empty set has the largest value in every coordinate.
    """
    out = np.full((len(sets), len(multipliers)), (1 << bits) - 1, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(sizes)
    shift = _U(64 - bits)
    at = 0
    while at < len(full):
        # About 32k hashes at a time stay in a core's cache.
        stop, held = at, 0
        while stop < len(full) and (stop == at or held + sizes[full[stop]] <= 1 << 15):
            held += sizes[full[stop]]
            stop += 1
        some = full[at:stop]
        values = np.concatenate([sets[i] for i in some])
        starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
        for k in range(len(multipliers)):
            out[some, k] = np.minimum.reduceat(values * multipliers[k] + addends[k], starts) >> shift
        at = stop
    return out
