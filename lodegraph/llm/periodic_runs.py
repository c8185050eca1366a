"""Periodic runs of words, found by a suffix automaton over each document.

A run is a stretch of words with smallest period q that no neighbour extends, of a length that is at
least `least` words and `times` periods. Words of one document become numbers, and a suffix automaton is
built over them: a state stands for substrings that end at the same positions. States give their end
positions to their suffix link's state, the smaller ordered set into the larger. A position that comes into
a set has new neighbours; if one lies d away and d * (times - 1) is no more than the state's length, the
state's longest string, which ends at both, has period d there: a seed. Both ends are
together for the first time in this state, so its longest string is all they have in common, and the run
starts where that string does for the first of them. Seeds of one start and period are extended to the run
that ends at the last of them. Within a run of smallest period q, ends q apart always become neighbours,
as a position between would give a smaller period; other distances that pass are multiples of q within the same run,
and are left out.

Words that can't be in a run are left out before: three words in a row that stand in a run (of `times` 4 and 6 words)
stand in it at least three times, so that only stretches of such words are taken up.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.shingles import mix, text_buffer, word_hashes
from lodegraph.llm.slices import sliced

Run = tuple[int, int, int]


@dataclass(frozen=True)
class Runs:
    """A run has at least `least` words and `times` periods."""

    least: int = 6
    times: int = 4


class Ends:
    """An ordered set of positions in blocks, so that insertion moves a block at most."""

    BLOCK = 512

    def __init__(self, first: int):
        self.blocks: list[list[int]] = [[first]]
        self.size = 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Puts in a new position; returns the ones before and after it, -1 where there is none."""
        blocks = self.blocks
        at = len(blocks) - 1
        if at and x < blocks[at][0]:
            low, high = 0, at
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if blocks[mid][0] < x else (low, mid - 1)
            at = low
        block = blocks[at]
        i = bisect_left(block, x)
        before = block[i - 1] if i else blocks[at - 1][-1] if at else -1
        after = block[i] if i < len(block) else blocks[at + 1][0] if at + 1 < len(blocks) else -1
        block.insert(i, x)
        self.size += 1
        if len(block) > 2 * self.BLOCK:
            blocks[at : at + 1] = [block[: self.BLOCK], block[self.BLOCK :]]
        return before, after


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link) of the suffix automaton's states, state 0 being the empty string, and the states of `words`' prefixes."""
    length, link, moves = [0], [-1], [{}]
    last, prefixes = 0, []
    for c in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        moves.append({})
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
        prefixes.append(new)
    return length, link, prefixes


def seeds(words: list[int], times: int) -> dict[tuple[int, int], int]:
    """The last end of each (start, distance) among neighbouring ends whose common string is `times` - 1 distances long."""
    length, link, prefixes = automaton(words)
    ends: list[Ends | None] = [None] * len(length)
    for at, state in enumerate(prefixes):
        ends[state] = Ends(at)
    found: dict[tuple[int, int], int] = {}
    by_length = np.argsort(-np.array(length), kind="stable").tolist()
    for state in by_length:
        parent = link[state]
        if parent <= 0:
            # the empty string has no period
            ends[state] = None
            continue
        large, small = ends[parent], ends[state]
        ends[state] = None
        if large is None:
            ends[parent] = small
            continue
        if large.size < small.size:
            large, small = small, large
        size, own = length[parent], -1
        for x in small:
            before, after = large.add(x)
            # two ends of the smaller set have met before
            if before != own and (x - before) * (times - 1) <= size:
                key = (before - size + 1, x - before)
                if found.get(key, -1) < x:
                    found[key] = x
            if after >= 0 and (after - x) * (times - 1) <= size:
                key = (x - size + 1, after - x)
                if found.get(key, -1) < after:
                    found[key] = after
            own = x
        ends[parent] = large
    return found


def runs_of(words: list[int], spec: Runs = Runs()) -> list[Run]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (start, period), end in sorted(seeds(words, spec.times).items()):
        own = by_start.setdefault(start, [])
        # a distance that is no smallest period is a multiple of one, whose run starts here too and reaches as far
        if not any(period % q == 0 and end <= e for q, e in own):
            own.append((period, end))
    out = [(start, end - start + 1, q) for start, own in by_start.items() for q, end in own]
    return sorted((s, n, q) for s, n, q in out if n >= max(spec.least, spec.times * q))


def _stretches(hashes: np.ndarray, bounds: np.ndarray, spec: Runs) -> Iterator[tuple[int, int, int]]:
    """(document, first, end): stretches of words of which each may stand in a run, by place among all words."""
    n = len(hashes)
    # three words in a row stand at least (times * q - 2) // q times in a run of period q
    times = min(spec.times - 1, max(spec.least, spec.times) - 2)
    if n < spec.least or times < 2:
        yield from ((d, a, b) for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if b - a >= spec.least)
        return
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    gram = mix(mix(mix(hashes[:-2] + owner[:-2]) ^ hashes[1:-1]) ^ hashes[2:])
    whole = owner[:-2] == owner[2:]
    order = np.argsort(gram, kind="stable")
    ordered = gram[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    count = np.empty(n - 2, np.int64)
    count[order] = np.repeat(np.diff(np.r_[first, n - 2]), np.diff(np.r_[first, n - 2]))
    begins = whole & (count >= times)
    kept = np.zeros(n, bool)
    for k in range(3):
        kept[k : n - 2 + k] |= begins
    edge = np.flatnonzero(np.diff(np.r_[False, kept, False].astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        # a stretch over several documents is cut at their borders
        while a < b:
            d = int(owner[a])
            stop = min(b, int(bounds[d + 1]))
            if stop - a >= spec.least:
                yield d, a, stop
            a = stop


def _document_runs(words: list[bytes], parts: list[tuple[int, int]], spec: Runs) -> list[Run]:
    out = []
    for a, b in parts:
        number: dict[bytes, int] = {}
        out += [(a + s, n, q) for s, n, q in runs_of([number.setdefault(w, len(number)) for w in words[a:b]], spec)]
    return sorted(out)


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Without words that stand in a run after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        drop[start + period] += 1
        drop[start + size] -= 1
    gone = np.cumsum(drop[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def find(texts: pa.Array, spec: Runs = Runs()) -> Iterator[tuple[list[bytes], list[Run]]]:
    """The words and the runs of each text."""
    hashes, bounds = word_hashes(*text_buffer(texts), lower=False)
    parts: dict[int, list[tuple[int, int]]] = {}
    for d, a, b in _stretches(hashes, bounds, spec):
        parts.setdefault(d, []).append((a - int(bounds[d]), b - int(bounds[d])))
    for d, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        words = (text or b"").split()
        yield words, _document_runs(words, parts[d], spec) if d in parts else []


def _strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length over period; of equals the one of least start, then period."""
    best = None
    for run in runs:
        # lengths over periods compared as products, which are exact
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def word_runs(docs: DataFrame, spec: Runs = Runs(), batch_bytes: int = 1 << 22) -> DataFrame:
    """(doc_id, runs, collapsed) of each row of `docs` (doc_id, text): runs (start, length, period) by start, then period, and the text without repeated periods, its words joined by blanks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in sliced(batch, 1, batch_bytes):
                runs, texts = [], []
                for words, own in find(part.column(1), spec):
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    texts.append(b" ".join(collapsed(words, own)).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, kind), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(docs: DataFrame, spec: Runs = Runs(), batch_bytes: int = 1 << 22) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row of `docs` (doc_id, text).

    Words are runs of characters other than blank, tab, LF, VT, FF and CR. start, length and period are those
    of the run with the greatest length over period, of equals the first; without a run they and
    exponent_milli are null, and n_runs is 0. Null text counts as empty: no words. A null doc_id stays null,
    rows that repeat have a result each, other columns don't matter, an empty table gives no rows. Nothing is shuffled.
    A task takes up one text, or several short ones, at a time; time grows as n log n in a text's words.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1, batch_bytes):
                rows = []
                for words, runs in find(part.column(1), spec):
                    best = _strongest(runs)
                    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    rows.append((len(runs), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(collapsed(words, runs)))))
                columns = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, schema)


def looped(docs: DataFrame) -> DataFrame:
    """`docs` with the words of one row in ten made periodic from some word on, by the checksum of doc_id, so that texts have runs.

    With h the crc32 of the decimal doc_id, g = h / 10 and n words: if h % 10 is 0, word i >= a = g % n becomes
    word a + (i - a) % p, where p = 1 + (n - a) / (3 + g % 8). Other texts, and those of a null doc_id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (h % 10 == 0).alias("hit"), F.floor(h / 10).alias("g"))
    n = F.size(F.col("words")).cast("long")
    cut = rows.withColumn("words", F.when(F.col("hit") & F.col("text").isNotNull(), words)).withColumn("a", F.when(n > 0, F.col("g") % n))
    cut = cut.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    turned = F.transform("words", lambda w, i: F.get("words", place(i).cast("int")))
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))
