"""Document fingerprints: MinHash signatures over word shingles, and their near-duplicate join.

A fingerprint is `permutations` 16-bit values, each the least of one universal hash
(a*x+b modulo 2**64, high bits) over the text's set of word shingles, written as
hexadecimal. The share of equal values estimates the sets' Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm.components import connected_components, side
from lodegraph.llm.near_dedup import NearDedup, list_links, verified_components
from lodegraph.llm.shingles import minhash, permutations, shingle_sets, text_buffer, word_hashes
from lodegraph.llm.token_files import spread_equal, stored_bytes
from lodegraph.llm.workspace import Workspace


@dataclass(frozen=True)
class Fingerprints:
    """Parameters: words in a shingle, permutations, values of a band, bands that a candidate pair shares, the similarity that links (percent), equal values of a candidate pair.

    `range_bytes` is how much stored text one task orders.
    """

    words: int = 5
    permutations: int = 64
    list_rows: int = 2
    shared: int = 8
    percent: int = 80
    matches: int = 36
    batch_rows: int = 256
    range_bytes: int = 1 << 27


def signatures(texts: pa.Array, p: Fingerprints) -> np.ndarray:
    """Signature matrix of 16-bit values; null counts as empty, and empty sets have the largest values."""
    sets = shingle_sets(*word_hashes(*text_buffer(texts)), p.words)
    return minhash(sets, *permutations(p.permutations), bits=16).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values, row by row."""
    return (a == b).mean(axis=1)


def hexadecimal(matrix: np.ndarray) -> list[str]:
    wide = matrix.astype(">u2")
    return [row.tobytes().hex() for row in wide]


def fingerprint(docs: DataFrame, params: Fingerprints | None = None) -> DataFrame:
    """(doc_id, fingerprint) for each row of `docs` (doc_id, text); equal texts have equal fingerprints."""
    p = params or Fingerprints()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, p.batch_rows):
                part = batch.slice(at, p.batch_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hexadecimal(signatures(part.column(1), p)))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last half of `text` (rounded down) replaced by as many first characters of `following`, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_DIGESTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in _DIGESTS.split(", ")]


def _finished(ids: list, texts: list[str], p: Fingerprints) -> list[pa.Array]:
    """Columns (_DIGESTS) for all but the last of a run of documents in order."""
    edited = [edited_text(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    own = signatures(pa.array(texts, pa.large_string()), p)
    changed = signatures(pa.array(edited, pa.large_string()), p)
    return [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array(hexadecimal(own[:-1]), pa.string()),
        pa.array(hexadecimal(changed), pa.string()),
        pa.array(likeness(own[:-1], changed), pa.float64()),
        pa.array(likeness(own[:-1], own[1:]), pa.float64()),
    ]


def edit_likeness(docs: DataFrame, params: Fingerprints | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, whose last half is the next document's beginning.

    Next goes by descending doc_id, then ascending text; after the last comes the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next for each row of `docs` (doc_id, text). Null text counts as empty; rows without
    doc_id come last. A lone document follows itself. Two texts without words are alike (1). Texts of any length are
    read whole. Other columns are not looked at. An empty table gives no rows.

    Documents are dealt out by ranges of that order, as many as the stored bytes need, and each range is one
    task. It finishes all of its documents but the last, and hands on its first and last text; these few, two a range, are
    written, and joined where one range follows another.
    """
    p, spark = params or Fingerprints(), docs.sparkSession
    work = Workspace(spark, "likeness")
    typed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(typed) // p.range_bytes))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        names = ["part", "edge", "text", *_NAMES]

        def edge(which: str, doc_id: int | None, text: str) -> pa.RecordBatch:
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([which]), pa.array([text], pa.string()), pa.array([doc_id], pa.int64()), *empty], names=names)

        ids: list = []
        texts: list[str] = []
        begun = False
        for batch in batches:
            for at in range(0, batch.num_rows, p.batch_rows):
                part = batch.slice(at, p.batch_rows)
                ids += part.column(0).to_pylist()
                texts += part.column(1).to_pylist()
                if not begun:
                    yield edge("first", ids[0], texts[0])
                    begun = True
                if len(ids) > 1:
                    n = len(ids) - 1
                    yield pa.RecordBatch.from_arrays([pa.array([here] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), *_finished(ids, texts, p)], names=names)
                ids, texts = ids[-1:], texts[-1:]
        if begun:
            yield edge("last", ids[0], texts[0])

    order = [F.col("doc_id").desc_nulls_last(), F.substring("text", 1, 32), "salt"]
    ordered = typed.withColumn("salt", spread_equal()).repartitionByRange(ranges, *order).sortWithinPartitions(order[0], "text").select("doc_id", "text")
    done = work.keep(ordered.mapInArrow(each, f"part int, edge string, text string, {_DIGESTS}"), "done")
    # a row a range
    parts = done.filter("edge = 'last'").select("part", "doc_id", "text")
    follows = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    first = done.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, text, following = (batch.column(k)[row].as_py() for k in range(3))
                yield pa.RecordBatch.from_arrays(_finished([doc_id, None], [text, following], p), names=_NAMES)

    seams = parts.join(follows, "part").join(first, "next").select("doc_id", "text", "following").mapInArrow(stitch, _DIGESTS)
    return done.filter("edge is null").select(*_NAMES).unionByName(seams)


def _bands(signature: Column, p: Fingerprints) -> Column:
    """One number a band of `list_rows` values, from the band's place and values."""
    width = 4 * p.list_rows
    bands = F.sequence(F.lit(0), F.lit(p.permutations // p.list_rows - 1))
    return F.transform(bands, lambda i: F.xxhash64(i, F.substring(signature, i * width + 1, F.lit(width))))


def _rare_bands(classes: DataFrame, p: Fingerprints) -> DataFrame:
    """(node, posting, n): the rarest bands of each class (node, fingerprint) that other classes have too.

    Two classes that share `shared` of K bands share one of any K - `shared` + 1, so that each is posted under so many of its
    rarest ones only; bands of one class use up that number and join nothing. What stands in very many texts,
    such as boilerplate, makes the frequent bands, which are skipped.
    """
    postings = classes.select("node", F.explode(_bands(F.col("fingerprint"), p)).alias("posting"))
    lengths = postings.groupBy("posting").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = postings.join(lengths.hint("merge"), "posting").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "posting"))).alias("lists"))
    rare = ranked.select("node", F.explode(F.expr(f"slice(lists, 1, greatest(0, size(lists) - {p.shared - 1}))")).alias("list"))
    return rare.select("node", F.col("list.posting").alias("posting"), F.col("list.n").alias("n"))


def near_components(spark: SparkSession, docs: DataFrame, params: Fingerprints | None = None) -> DataFrame:
    """(doc_id, component_id): near-duplicates by banded fingerprints, verified by exact Jaccard similarity.

    Texts with equal fingerprints form a class. Classes that share `shared` of their bands and at least `matches` of all
    values are candidates, found under their rarest bands, whose classes are compared in blocks; components of these hold every
    such pair, and full shingle sets decide within them (see `near_dedup.verified_components`). A pair at the threshold 0.8
    shares fewer than 8 of 32 bands of 2 with chance 1e-6, and fewer than 36 of 64 values with chance 2e-6. Null texts and documents without words link to
    nothing; texts of any length are read whole. Rows without doc_id are left out; rows that share one have the links of all their texts. Other columns are not
    looked at. An empty table gives no rows.
    """
    p = params or Fingerprints()
    work = Workspace(spark, "fingerprints")
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    prints = work.keep(fingerprint(docs, p), "prints")
    blank = "f" * (4 * p.permutations)
    classes = work.keep(prints.filter(F.col("fingerprint") != blank).groupBy("fingerprint").agg(F.min("doc_id").alias("node")).withColumn("class", F.xxhash64("fingerprint")), "classes")
    values = F.transform(F.sequence(F.lit(0), F.lit(p.permutations - 1)), lambda i: F.conv(F.substring("fingerprint", i * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    rules = NearDedup(words=p.words, percent=p.percent, coordinates=p.permutations, matches=p.matches, batch_rows=p.batch_rows)
    signed = classes.select(F.col("class").alias("node"), F.lit(1).cast("long").alias("n_shingles"), values.alias("signature"))
    rare = _rare_bands(classes.select(F.col("class").alias("node"), "fingerprint"), p)
    links = list_links(signed.join(rare.hint("merge"), "node").withColumn("blocks", F.ceil(F.col("n") / rules.list_block).cast("long")).drop("n"), rules)
    found = work.keep(connected_components(work, links, "cluster"), "clusters")
    linked = found.count()
    clusters = classes.select(F.col("class").alias("node"), F.col("node").alias("doc")).join(side(found, linked), "node").select(F.col("doc").alias("head"), F.col("component").alias("cluster"))
    # equal fingerprints need not mean equal sets, so all members are verified
    members = prints.join(classes.select("fingerprint", F.col("node").alias("head"), "class").hint("merge"), "fingerprint").join(side(clusters, linked), "head", "left")
    members = members.select(F.col("doc_id").alias("node"), F.coalesce("cluster", "class").alias("cluster"))
    weights = docs.select(F.col("doc_id").alias("node"), (F.length("text") / 6).alias("n_shingles"))
    several = members.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    near = members.join(several.hint("merge"), "cluster", "left_semi").join(weights.hint("merge"), "node").select("node", "cluster", "n_shingles")
    component = verified_components(work, docs, near, rules)
    return prints.select("doc_id").distinct().join(component.hint("merge"), F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
