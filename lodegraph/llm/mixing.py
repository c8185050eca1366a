"""Mixing documents to target domain weights, by soft membership.

A softmax classifier fitted on labelled documents gives each document a posterior
over domains. Rates r, one a document and within bounds, are fitted so that the expected
tokens of each domain, sum of r * tokens * posterior, meet a target: least squares
by projected gradient, with a slight pull of rates to 1 that makes the solution the only one. A round takes
the gradient at the present rates, which is one distributed sum of as many numbers as there are domains,
scales it by the curvature that documents within their bounds have, and adds it to a step y; the
rate of a document is 1 + posterior . y, projected onto its bounds. The scaling makes rounds few.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.ngrams import SHAPES, byte_grams, word_shapes
from lodegraph.llm.samples import labelled
from lodegraph.llm.shingles import text_buffer
from lodegraph.llm.workspace import Workspace


@dataclass(frozen=True)
class Mixing:
    """Parameters.

    `targets`: token share by domain, of `total` tokens; None takes the least total at which
    no domain with a target is thinned out, and the share `spare` more. A domain of target None is told apart but has no share to meet. A labelled row's domain is its `domain` column where
    its quality is 1, and `low` elsewhere. `sample` bounds the labelled rows of each
    quality that the classifier is fitted on; `bits`: byte n-grams go to 2**bits features.
    The fit ends where the gradient, over the wanted tokens, is within `tolerance`; `rounds` bounds it, and a fit that
    ends there, with the best step so far, is logged as a warning, or with `strict` is an error. `ridge`: the weight of the pull to 1. No rate is above
    `most`. `least`: no rate falls below it where the domains with a target above `small` are at least as probable as any other.
    """

    targets: dict[str, float | None] = field(default_factory=lambda: {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15, "low": 0.02})
    total: float | None = None
    spare: float = 0.0
    domain: str = "lang"
    low: str = "low"
    sample: int = 6000
    bits: int = 10
    steps: int = 300
    l2: float = 1e-4
    rounds: int = 60
    tolerance: float = 1e-7
    strict: bool = False
    ridge: float = 1e-7
    most: float = 20.0
    least: float = 0.0
    small: float = 0.05
    seed: int = 29
    batch_rows: int = 256


def text_features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text, square roots of the shares of byte n-grams and of word shapes, and its number of words."""
    data, offsets = text_buffer(texts)
    n = len(offsets) - 1
    parts = []
    shapes, words = word_shapes(data, offsets)
    for (buckets, bounds), size in ((byte_grams(data, offsets, bits), 1 << bits), ((shapes, words), SHAPES)):
        owner = np.repeat(np.arange(n), np.diff(bounds))
        table = np.bincount(owner * size + buckets, minlength=n * size).reshape(n, size)
        parts.append(np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1)).astype(np.float32))
    return np.hstack(parts), np.diff(words)


@dataclass
class Softmax:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return (z / z.sum(axis=1, keepdims=True)).astype(np.float64)


def fit_softmax(x: np.ndarray, domain: np.ndarray, domains: list[str], weight: np.ndarray, steps: int, l2: float) -> Softmax:
    """Weighted multinomial logistic regression by Adam on all rows at once. A domain without rows has no probability."""
    y = (domain[:, None] == np.arange(len(domains))[None, :]).astype(np.float32)
    w, b = np.zeros((x.shape[1], len(domains)), np.float32), np.where(y.any(axis=0), 0.0, -40.0).astype(np.float32)
    share = (weight / weight.sum()).astype(np.float32)[:, None]
    m, v = np.zeros_like(w), np.zeros_like(w)
    mb, vb = np.zeros_like(b), np.zeros_like(b)
    for step in range(1, steps + 1):
        z = x @ w + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = (z / z.sum(axis=1, keepdims=True) - y) * share
        g, gb = x.T @ d + l2 * w, d.sum(axis=0)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, cv = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.1 * (m / c) / (np.sqrt(v / cv) + 1e-7)
        b -= 0.1 * (mb / c) / (np.sqrt(vb / cv) + 1e-7)
    return Softmax(domains, w, b)


def fit_classifier(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Mixing) -> Softmax | None:
    """The domain classifier, fitted on the driver on a bounded labelled sample; None without labelled texts."""
    domains = list(p.targets)
    work = Workspace(spark, "domains")
    # labels of rows that an earlier stage took out say nothing about these documents
    here = docs.select(F.col("doc_id").cast("long").alias("id")).distinct()
    present = work.keep(labels.join(here.hint("merge"), F.col("doc_id").cast("long") == F.col("id"), "left_semi"), "present")
    chosen = work.keep(labelled(present, "quality", p.sample), "sample")
    counted = present.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    totals = {r["label"]: r["count"] for r in counted.groupBy("label").count().collect()}
    own = F.coalesce(F.col(p.domain).cast("string"), F.lit("")) if p.domain in docs.columns else F.lit("")
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own.alias("domain"))
    # a bounded number of ids
    some = typed.join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), F.col("doc_id") == F.col("id"))
    some = some.select("text", F.when(F.col("label") == 1, F.col("domain")).otherwise(F.lit(p.low)).alias("domain"), "label").filter(F.col("domain").isin(*domains))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, p.batch_rows):
                part = batch.slice(at, p.batch_rows)
                x, _ = text_features(part.column(0), p.bits)
                yield pa.RecordBatch.from_arrays([pa.array([row.astype(np.float16).tobytes() for row in x], pa.binary()), part.column(1), part.column(2)], names=["x", "domain", "label"])

    rows = some.mapInArrow(each, "x binary, domain string, label int").toPandas()
    if not len(rows):
        return None
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float16).reshape(len(rows), -1).astype(np.float32)
    label = rows["label"].to_numpy()
    weight = np.array([totals[k] / max(1, (label == k).sum()) for k in label])
    return fit_softmax(x, np.array([domains.index(d) for d in rows["domain"]]), domains, weight, p.steps, p.l2)


def memberships(spark: SparkSession, docs: DataFrame, model: Softmax, p: Mixing) -> DataFrame:
    """(doc_id, tokens, posterior) of each row of `docs`: whole words, and an array in the order of `targets`."""
    shared = spark.sparkContext.broadcast(model)  # 2**bits by domains
    width = len(model.domains)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, p.batch_rows):
                part = batch.slice(at, p.batch_rows)
                x, tokens = text_features(part.column(1), p.bits)
                posterior = shared.value.posteriors(x).ravel()
                listed = pa.ListArray.from_arrays(np.arange(0, len(posterior) + 1, width, dtype=np.int32), pa.array(posterior))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), listed], names=["doc_id", "tokens", "posterior"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, tokens long, posterior array<double>")


def _dot(y: np.ndarray) -> Column:
    out = F.lit(0.0)
    for k, value in enumerate(y):
        out = out + F.col("posterior")[k] * F.lit(float(value))
    return out


def lower_bound(p: Mixing) -> Column:
    """What a rate is cut off at: `least` where a domain with a target is at least as probable as any without one, else 0."""
    best = lambda ks: F.array_max(F.array(*(F.col("posterior")[k] for k in ks)))
    shares = list(p.targets.values())
    wanted, others = [k for k, s in enumerate(shares) if (s or 0.0) > p.small], [k for k, s in enumerate(shares) if (s or 0.0) <= p.small]
    if p.least <= 0 or not wanted:
        return F.lit(0.0)
    return F.when(best(wanted) >= best(others), F.lit(p.least)).otherwise(F.lit(0.0)) if others else F.lit(p.least)


def rate(y: np.ndarray, p: Mixing) -> Column:
    """The rate after the accumulated step `y`: 1 + posterior . y within its bounds."""
    return F.least(F.lit(p.most), F.greatest(lower_bound(p), F.lit(1.0) + _dot(y)))


@dataclass
class Fit:
    """The accumulated step, tokens by domain that it reaches and that are wanted, and whether and in how many rounds it converged."""

    y: np.ndarray
    reached: np.ndarray
    wanted: np.ndarray
    rounds: int = 0
    converged: bool = True

    @property
    def residual(self) -> float:
        """How far reached tokens are from wanted ones, as a share of these."""
        return float(np.abs(self.reached - self.wanted).sum() / max(1.0, self.wanted.sum()))


def _sums(table: DataFrame, y: np.ndarray, p: Mixing) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by domain at the rates of `y`, and the Gram matrix of documents whose rates are within their bounds."""
    d = len(y)
    post = lambda k: F.col("posterior")[k]
    rated = table.select(F.col("tokens").cast("double").alias("t"), "posterior", rate(y, p).alias("r"), lower_bound(p).alias("low"))
    free = F.when((F.col("r") > F.col("low")) & (F.col("r") < p.most), F.col("t")).otherwise(F.lit(0.0))
    got = rated.agg(*(F.sum(F.col("t") * F.col("r") * post(k)).alias(f"s{k}") for k in range(d)), *(F.sum(free * post(i) * post(j)).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d))).first()
    value = lambda name: got[name] or 0.0
    return np.array([value(f"s{k}") for k in range(d)]), np.array([[value(f"g{min(i, j)}_{max(i, j)}") for j in range(d)] for i in range(d)])


def fit_rates(table: DataFrame, p: Mixing) -> Fit:
    """The fit of rates to targets. `table`: tokens, posterior. Without tokens nothing is wanted and rates stay 1."""
    d = len(p.targets)
    post = lambda k: F.col("posterior")[k]
    t = F.col("tokens").cast("double")
    first = table.agg(*(F.sum(t * post(k)).alias(f"n{k}") for k in range(d)), *(F.sum(t * post(i) * post(j)).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d))).first()
    if not first["n0"]:
        return Fit(np.zeros(d), np.zeros(d), np.zeros(d))
    plain = np.array([first[f"n{k}"] for k in range(d)])
    whole = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    # a domain that no document is of can't be given a share
    given = np.array([s is not None for s in p.targets.values()]) & (plain > 1e-9 * plain.sum())
    share = np.where(given, [s or 0.0 for s in p.targets.values()], 0.0)
    share = share / max(share.sum(), 1e-300)
    total = p.total if p.total is not None else (1 + p.spare) * max((n / s for n, s in zip(plain, share, strict=True) if s > p.small), default=0.0)
    scale, among = max(1.0, total), np.outer(given, given)
    # what has no share to meet is left as it comes
    slope = lambda y, now: np.where(given, now - share * total + p.ridge * (whole * among) @ y, 0.0)
    wanted = lambda now: np.where(given, share * total, now)
    norm = np.linalg.pinv(whole * among, rcond=1e-12, hermitian=True)
    y = np.zeros(d)
    now, free = _sums(table, y, p)
    gradient = slope(y, now)
    best = (gradient @ norm @ gradient, y, now)
    for k in range(p.rounds):
        if np.abs(gradient).sum() <= p.tolerance * scale:
            return Fit(y, now, wanted(now), k)
        move = -np.linalg.lstsq((free + p.ridge * whole) * among, gradient, rcond=1e-12)[0]
        size, merit = 1.0, gradient @ norm @ gradient
        while True:
            tried = y + size * move
            now, free = _sums(table, tried, p)
            new = slope(tried, now)
            if new @ norm @ new < merit or size < 1e-3:
                break
            size /= 4
        y, gradient = tried, new
        best = min(best, (new @ norm @ new, y, now), key=lambda b: b[0])
        if size < 1e-3:
            break
    _, y, now = best
    gradient = slope(y, now)
    fit = Fit(y, now, wanted(now), p.rounds, bool(np.abs(gradient).sum() <= p.tolerance * scale))
    if not fit.converged:
        said = f"rates have not converged in {p.rounds} rounds: {fit.residual:.2g} of the wanted tokens are missed"
        if p.strict:
            raise RuntimeError(said)
        logging.getLogger(__name__).warning(said)
    return fit


def fitted(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Mixing) -> tuple[Fit | None, DataFrame | None]:
    """The fit and the table (doc_id, tokens, posterior) it is for; None without labelled texts."""
    model = fit_classifier(spark, docs, labels, p)
    if model is None:
        return None, None
    table = Workspace(spark, "mixing").keep(memberships(spark, docs, model, p), "memberships")
    return fit_rates(table, p), table


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: Mixing | None = None) -> DataFrame:
    """(doc_id, tokens, rate, and p_<domain> for each target) for each row of `docs` (doc_id, text, and the domain column).

    `labels`: doc_id, quality. Null and empty texts have no tokens; their rate follows from the
    classifier's constant alone and moves no total. Repeated rows have equal rates, and a null doc_id stays null. Texts of
    any length are read whole. Other columns are not looked at. Without
    labelled texts rates are 1 and posteriors null. An empty table gives no rows.
    """
    p = params or Mixing()
    fit, table = fitted(spark, docs, labels, p)
    if table is None:
        nothing = [F.lit(None).cast("double").alias(f"p_{name}") for name in p.targets]
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("tokens"), F.lit(1.0).alias("rate"), *nothing)
    return table.select("doc_id", "tokens", rate(fit.y, p).alias("rate"), *(F.col("posterior")[k].alias(f"p_{name}") for k, name in enumerate(p.targets)))


def mixed_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: Mixing | None = None) -> DataFrame:
    """`docs` with each row as often as its rate says: the whole part, and one more with the rest as chance, by a hash of doc_id.

    The columns stay as they are; equal rows are copies. Posteriors of rows that share a
    doc_id are averaged for the purpose; rows without doc_id count as sharing one. An empty table gives no rows.
    """
    p = params or Mixing()
    fit, table = fitted(spark, docs, labels, p)
    if table is None:
        return docs
    chance = F.pmod(F.xxhash64(F.col("id"), F.lit(p.seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # a rate just below a whole number is that number
    times = F.floor(rate(fit.y, p) + F.lit(1e-6) + chance).cast("int")
    counts = table.withColumnRenamed("doc_id", "id").select("id", times.alias("n")).groupBy("id").agg(F.round(F.avg("n")).cast("int").alias("n"))
    # the row's own columns stay in a struct, so that no name can clash
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"))
    joined = rows.join(counts.hint("merge"), rows["key"].eqNullSafe(counts["id"])).filter("n > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")
