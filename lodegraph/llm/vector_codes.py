"""Vectors compressed to codes: a codebook for each part of a vector, trained by rounds of exact integer arithmetic.

Components become integers floor(scale * x). A round sends the codebooks, `parts` x `entries` short
integer vectors, to the tasks; each takes the squared distance of all its parts to all entries of their
codebook as |x|^2 - 2 x.c + |c|^2 in 64-bit integers, assigns each part to the first nearest
entry, and gives one row an entry with the count and the sum of what was assigned to it. Those are added up in a
shuffle of at most `parts` x `entries` rows a task, and make the next codebooks. Integers
keep every sum exact, so results don't depend on how rows are dealt out or on a task that runs again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.workspace import Workspace


@dataclass(frozen=True)
class Codes:
    """How vectors are compressed. Labels of up to `few_labels` different values are broadcast with their sums."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    few_labels: int = 10_000


def _usable(vector: str) -> F.Column:
    """Whether a vector has components, and all of them are there and finite."""
    value = F.col(vector)
    return F.coalesce((F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _integers(vectors: pa.Array, spec: Codes) -> np.ndarray:
    """Rows of integer components; vectors of other lengths or beyond exact arithmetic are refused."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes.min() != sizes.max() or sizes[0] % spec.parts):
        raise ValueError(f"vectors have {sizes.min()} to {sizes.max()} components; all need the same number, a multiple of {spec.parts}")
    width = int(sizes[0]) if len(sizes) else 0
    scaled = np.floor(pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64) * spec.scale)
    # squared distances, summed over all components, stay below 2**63
    most = 2.0 ** (30 - width.bit_length() / 2)
    if len(scaled) and np.abs(scaled).max() > most:
        raise ValueError(f"components beyond {most / spec.scale:g} don't fit 64-bit distances of {width} components")
    return scaled.astype(np.int64).reshape(len(sizes), width)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part of the rows `x`; books are parts x entries x width. Ties go to the lower entry."""
    parts, _, width = books.shape
    cut = x.reshape(len(x), parts, width).transpose(1, 0, 2)
    near = np.empty((parts, len(x)), np.int64)
    far = np.empty((parts, len(x)), np.int64)
    for p in range(parts):
        own, book = cut[p], books[p]
        # |x|^2 is the same for all entries, and is added to the least
        rest = (book * book).sum(axis=1)[None, :] - 2 * (own @ book.T)
        near[p] = rest.argmin(axis=1)
        far[p] = rest[np.arange(len(own)), near[p]] + (own * own).sum(axis=1)
    return near.T, far.T


def _batches(batches: Iterator[pa.RecordBatch], column: int, spec: Codes, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, _integers(part.column(column), spec)


def _first_books(kept: DataFrame, spec: Codes) -> np.ndarray:
    """The parts of the vectors of least vec_id: a top-k of `entries` rows. Of one vec_id, lesser vectors come first; null ids come last."""
    rows = kept.select(F.col("vec_id").cast("long").alias("id"), "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(spec.entries).collect()
    x = _integers(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), spec)
    return x.reshape(len(x), spec.parts, x.shape[1] // spec.parts).transpose(1, 0, 2)


def _round(kept: DataFrame, books: np.ndarray, spec: Codes) -> np.ndarray:
    """The codebooks after one assignment of all parts: the floor of each entry's mean; entries that nothing is assigned to stay."""
    spark = kept.sparkSession
    parts, entries, width = books.shape
    sent = spark.sparkContext.broadcast(books)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for _, x in _batches(batches, 0, spec):
            near, _ = nearest(x, sent.value)
            slot = (near + np.arange(parts) * entries).reshape(-1)
            counts += np.bincount(slot, minlength=parts * entries)
            np.add.at(sums, slot, x.reshape(-1, width))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), *(pa.array(sums[used, k]) for k in range(width))], names=["slot", "n", *columns])

    columns = [f"s{k}" for k in range(width)]
    told = kept.select("vector").mapInArrow(each, ", ".join(f"{c} long" for c in ("slot", "n", *columns)))
    out = books.reshape(parts * entries, width).copy()
    # a row an entry at most
    for row in told.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).collect():
        out[row["slot"]] = [row[c] // row["n"] for c in columns]
    sent.unpersist()
    return out.reshape(parts, entries, width)


def books_digest(books: np.ndarray) -> str:
    """sha256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def train(kept: DataFrame, spec: Codes = Codes()) -> np.ndarray:
    """Codebooks (parts x entries x width) of the rows (vec_id, vector). Fewer rows than `entries` make fewer entries."""
    books = _first_books(kept, spec)
    for _ in range(spec.rounds if books.size else 0):
        books = _round(kept, books, spec)
    return books


def encode(kept: DataFrame, books: np.ndarray, spec: Codes = Codes()) -> DataFrame:
    """(vec_id, label, codes, error) of the rows (vec_id, vector, label): an entry a part, and the squared distances' sum."""
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _batches(batches, 2, spec):
            near, far = nearest(x, sent.value)
            codes = pa.array([row.tobytes() for row in near.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), codes, pa.array(far.sum(axis=1))], names=["vec_id", "label", "codes", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "vector").mapInArrow(each, f"vec_id long, label {label}, codes binary, error long")


def compress(spark: SparkSession, vectors: DataFrame, spec: Codes = Codes()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the usable rows of `vectors` (vec_id, embedding, label).

    A row is left out if its embedding is null, empty, or holds a null or a component that isn't finite.
    code has two hex digits a part; label_error is the error summed over rows of equal label, null being one.
    Rows that repeat, or share a vec_id, each have a result; a null vec_id stays null and comes last among
    the first codebooks. Other columns don't matter. An empty table gives no rows. Embeddings of several lengths,
    of a length that `parts` doesn't divide, or too large for exact sums raise an error. At most 256 entries.
    """
    if not 1 <= spec.entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    space = Workspace(spark, "codes")
    usable = vectors.filter(_usable("embedding"))
    kept = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    books = train(kept, spec)
    if not books.size:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = space.keep(encode(kept, books, spec), "coded")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    totals = space.keep(totals, "totals")
    if totals.count() <= spec.few_labels:
        totals = F.broadcast(totals)
    told = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return told.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle(spec: Codes = Codes()) -> str:
    """DuckDB SQL for `compress` of the table `embeddings`, whose vec_ids differ."""
    assign = lambda k: f"""a{k} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) AS r FROM (
SELECT v.vec_id, v.part, c.entry, sum((v.x - c.c) * (v.x - c.c)) AS d FROM v JOIN c{k} c ON c.part = v.part AND c.pos = v.pos GROUP BY v.vec_id, v.part, c.entry)) WHERE r = 1)"""  # noqa: E731
    renew = lambda k: f"""c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(m.mean, c.c) AS c FROM c{k} c LEFT JOIN (
SELECT a.part, a.entry, v.pos, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS mean FROM a{k} a JOIN v ON v.vec_id = a.vec_id AND v.part = a.part GROUP BY a.part, a.entry, v.pos) m USING (part, entry, pos))"""  # noqa: E731
    rounds = ",\n".join(f"{assign(k)},\n{renew(k)}" for k in range(spec.rounds))
    last = spec.rounds
    return f"""WITH k AS MATERIALIZED (SELECT vec_id, label, embedding, len(embedding) // {spec.parts} AS width FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
e AS (SELECT vec_id, label, width, unnest(embedding) AS y, unnest(range(0, len(embedding))) AS i FROM k),
v AS MATERIALIZED (SELECT vec_id, label, i // width AS part, i % width AS pos, CAST(floor(CAST(y AS DOUBLE) * {spec.scale}) AS BIGINT) AS x FROM e),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k),
c0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM v JOIN f USING (vec_id) WHERE entry < {spec.entries}),
{rounds},
{assign(last)},
b AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{last}),
w AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id),
o AS (SELECT w.*, k.label FROM w JOIN k USING (vec_id))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, b"""
