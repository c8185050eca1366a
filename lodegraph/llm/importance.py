"""Quality by importance resampling.

Two generative models of hashed n-grams, one of target text (labelled good) and one
of all raw text, give each document the log ratio of its probabilities. Documents
are drawn without replacement by Gumbel top-k: the k largest of log ratio plus
Gumbel noise. N-grams are words and pairs of words, and trigrams of word shapes, which tell prose
from shouting, tables, symbol noise and repetition in words never seen before; the kinds
are models of their own, whose log ratios add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.ngrams import shape_grams, sums, word_grams
from lodegraph.llm.samples import kth_largest, labelled
from lodegraph.llm.shingles import mix
from lodegraph.llm.workspace import Workspace


#: Kinds of n-grams; each has 2**bits buckets of its own.
KINDS = (shape_grams, word_grams)


@dataclass(frozen=True)
class Importance:
    """Parameters.

    `sample` bounds the labelled rows of each class that the target model and k are fitted on.
    `bits`: n-grams of a kind go to 2**bits buckets. Counts are raised by `smoothing`, so that what is too
    rare for the sample, in a rare language too, weighs next to nothing. `keep` fixes k as a share of all rows; None takes
    as k the number of documents whose weight passes the cut that best parts labelled rows of the two classes, where the good
    ones are a share `held` that the target model was not fitted on. `temperature` scales the Gumbel noise: its scale is that share
    of the distance from the cut to the median of held good rows, so at a quarter a median document is missed with chance e**-55 and one
    at the cut with chance 1/e. Without a cut (no labels of both kinds) the scale is `temperature` itself.
    """

    sample: int = 20_000
    bits: int = 16
    smoothing: float = 50.0
    keep: float | None = None
    held: float = 0.25
    temperature: float = 0.25
    seed: int = 17
    batch_rows: int = 256


#: Log ratios are summed as whole multiples of 1 / UNIT.
UNIT = 1 << 20


def _counts(docs: DataFrame, p: Importance) -> np.ndarray:
    """n-gram counts of all rows' texts, a row a kind; what reaches the driver is one number a bucket."""
    size = 1 << p.bits

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(KINDS), size), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, p.batch_rows):
                for k, grams in enumerate(KINDS):
                    total[k] += np.bincount(grams(batch.column(0).slice(at, p.batch_rows), p.bits)[0], minlength=size)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(KINDS) * size)
    out[found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    return out.reshape(len(KINDS), size)


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float) -> np.ndarray:
    """Log ratios of target to raw probability by kind and bucket. Target counts are held against those expected at the raw model's probabilities."""
    expected = raw * (target.sum(axis=1, keepdims=True) / np.maximum(1.0, raw.sum(axis=1, keepdims=True)))
    return np.log(target + smoothing) - np.log(expected + smoothing)


def fit(docs: DataFrame, good: DataFrame, p: Importance) -> np.ndarray:
    """Log ratios by kind and bucket. `good`: doc_id of target documents, a bounded number."""
    target = _counts(docs.join(F.broadcast(good.select(F.col("doc_id").alias("id"))), F.col("doc_id") == F.col("id"), "left_semi"), p)
    return log_ratios(target, _counts(docs, p), p.smoothing)


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise that depends on id and seed alone."""
    u = (mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def keys_of(ids: pa.Array, texts: pa.Array) -> np.ndarray:
    """What a row's noise depends on: its doc_id, or a digest of its text where that is null."""
    out = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).copy()
    for k in np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)):
        out[k] = int.from_bytes(hashlib.blake2b((texts[int(k)].as_py() or "").encode(), digest_size=8).digest(), "little", signed=True)
    return out


def weigh(docs: DataFrame, ratios: np.ndarray, p: Importance) -> DataFrame:
    """`docs` with log_weight, the log ratio of each whole text, mean_weight, the same a word, and noise, which is standard Gumbel. Texts without words weigh 0."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(np.rint(ratios * UNIT).astype(np.int64))  # 2**bits numbers a kind

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, p.batch_rows):
                part = batch.slice(at, p.batch_rows)
                ids, texts = part.column(names.index("doc_id")), part.column(names.index("text"))
                total, words = np.zeros(part.num_rows, np.int64), np.ones(part.num_rows, np.int64)
                for table, grams in zip(tables, KINDS, strict=True):
                    buckets, bounds = grams(texts, p.bits)
                    total += sums(table[buckets], bounds)
                    if grams is shape_grams:
                        words = np.maximum(np.diff(bounds), 1)
                weight = total / UNIT
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(weight), pa.array(weight / words), pa.array(gumbel(keys_of(ids, texts), p.seed))], names=[*names, "log_weight", "mean_weight", "noise"])

    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    return docs.mapInArrow(each, T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in ("log_weight", "mean_weight", "noise"))]))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that parts good from bad with the least sum of both error rates, midway in its gap; -inf without both."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weights)
    w, g = weights[order], good[order]
    lost = np.r_[0, np.cumsum(g)] / g.sum()
    passed = 1 - np.r_[0, np.cumsum(~g)] / (~g).sum()
    edge = np.r_[True, w[1:] != w[:-1], True]
    errors = np.where(edge, lost + passed, np.inf)
    at = int(np.argmin(errors))
    if at == 0:
        return -np.inf
    return float((w[at - 1] + w[min(at, len(w) - 1)]) / 2)


def scale_of(weights: np.ndarray, good: np.ndarray, p: Importance) -> tuple[float, float]:
    """(cut, scale of the noise) from weights of labelled rows."""
    cut = best_cut(weights, good)
    return cut, p.temperature * max(float(np.median(weights[good])) - cut, 0.0) if np.isfinite(cut) else p.temperature


def drawn(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Importance, columns: list[str], key: str) -> tuple[DataFrame, float]:
    """`columns` of `docs` with log_weight, mean_weight and gumbel_key, and the k-th largest key; every row is scored once. `key` is the doc_id among `columns`."""
    work = Workspace(spark, "importance")
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1000))
    chosen = work.keep(labelled(labels, "quality", p.sample).withColumn("fitted", (F.col("label") == 1) & (bucket >= round(1000 * p.held))), "sample")
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratios = fit(typed, chosen.filter("fitted"), p)
    scores = work.keep(weigh(docs, ratios, p).select(*columns, "log_weight", "mean_weight", "noise"), "scores")
    # a bounded number of ids
    held = F.broadcast(chosen.filter("not fitted").select(F.col("doc_id").alias("id"), "label"))
    own = scores.select(F.col(key).cast("long").alias("own"), "mean_weight")
    known = own.join(held, F.col("own") == F.col("id")).select("mean_weight", "label").toPandas()
    cut, scale = scale_of(known["mean_weight"].to_numpy(), known["label"].to_numpy() == 1, p)
    k = scores.filter(F.col("mean_weight") >= F.lit(cut)).count() if p.keep is None else round(p.keep * scores.count())
    work.drop("sample")
    scores = scores.withColumn("gumbel_key", F.col("mean_weight") + F.lit(scale) * F.col("noise")).drop("noise")
    least = kth_largest(scores, "gumbel_key", k)
    return scores, (np.inf if k < 1 else -np.inf) if least is None else least


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: Importance | None = None) -> DataFrame:
    """(doc_id, log_weight, mean_weight, gumbel_key, kept) for each row of `docs` (doc_id, text); kept are the k largest keys, ties at the last kept too.

    `labels`: doc_id, quality. Without labels of both kinds among `docs` every document is kept. Null and
    empty texts weigh 0, and texts of any length are scored whole. Rows that repeat have equal weights and, by doc_id, equal
    noise; the noise of rows without doc_id is by their text. Other columns are not looked at. An empty table gives no rows.
    """
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scores, least = drawn(spark, typed, labels, params or Importance(), ["doc_id"], "doc_id")
    return scores.select("doc_id", "log_weight", "mean_weight", "gumbel_key", (F.col("gumbel_key") >= F.lit(least)).alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: Importance | None = None) -> DataFrame:
    """The rows of `docs` that `resample` keeps, with their own columns."""
    # a row's own columns stay in a struct, so that no name can clash
    rows = docs.select("doc_id", "text", F.struct("*").alias("row"))
    scores, least = drawn(spark, rows, labels, params or Importance(), ["row"], "row.doc_id")
    return scores.filter(F.col("gumbel_key") >= F.lit(least)).select("row.*")
