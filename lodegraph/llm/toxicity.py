"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade > g) = logistic(w.x - t_g) with one weight vector for all thresholds
t_0 < t_1 < ...; the likelihood of a row of grade g is P(grade > g - 1) - P(grade > g), and expected severity
is the sum of P(grade > g) over g. Features are the presence of words, and that words of one beginning stand in a text
once, twice or more often: abuse in an inflected language repeats its stems, which clean text may hold once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.samples import labelled
from lodegraph.llm.shingles import letters_only, mix, text_buffer, word_hashes
from lodegraph.llm.workspace import Workspace


@dataclass(frozen=True)
class Severity:
    """Parameters.

    `sample` bounds the labelled rows of each class that the model is fitted on, `features`
    the words and beginnings (of `prefix` bytes, with up to `levels` times that they occur) it uses, those that part the classes best
    (by likelihood ratio, which must reach that of `evidence` under which rows left out in cross-validation are likeliest) and occur in `least_docs` sampled documents; rarer ones and those beyond
    `features` weigh nothing. A beginning may end inside a character of several bytes, which still names the same words.
    Labels say toxic or not; toxic rows are graded 1 to `grades` - 1, in equal parts, by the score that a binary model gives
    them which was fitted, features too, without their fold. The cut that makes
    a row toxic is the largest, a half at most, that catches `recall` of the toxic rows left out in `folds`-fold
    cross-validation, or where that takes more than `false_positives` of the clean rows, the least that doesn't.
    """

    sample: int = 6000
    features: int = 1024
    least_docs: int = 3
    evidence: tuple[float, ...] = (6.0, 15.0)
    prefix: int = 5
    levels: int = 3
    grades: int = 4
    l2: float = 1e-4
    steps: int = 250
    recall: float = 0.97
    false_positives: float = 0.01
    folds: int = 4
    batch_rows: int = 256


_LETTERS = letters_only()


_BASE = ~np.uint64(3)


def occurrences(texts: pa.Array, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, base) of every word and word beginning, repeats included. A base is a hash whose last two bits are 0 for a word and 1 for a beginning."""
    data, offsets = text_buffer(texts)
    words, bounds = word_hashes(data, offsets, separator=_LETTERS)
    starts, _ = word_hashes(data, offsets, separator=_LETTERS, prefix=prefix)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.r_[owner, owner], np.r_[words & _BASE, (mix(starts + np.uint64(7)) & _BASE) | np.uint64(1)]


def presence(owner: np.ndarray, base: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) without repeats: words as they are, and beginnings for each number of times, up to `levels` (3 at most), that they occur, in their last two bits."""
    order = np.lexsort((base, owner))
    owner, base = owner[order], base[order]
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (base[1:] != base[:-1])][: len(base)])
    times = np.diff(np.r_[first, len(base)])
    owner, base = owner[first], base[first]
    start = (base & ~_BASE) == 1
    found = [(owner[~start], base[~start])]
    for level in range(1, levels + 1):
        often = start & (times >= level)
        found.append((owner[often], (base[often] & _BASE) | np.uint64(level)))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _features(docs: DataFrame, p: Severity) -> DataFrame:
    """(doc_id, feature) without repeats in a document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, p.batch_rows):
                part = batch.slice(at, p.batch_rows)
                owner, feature = presence(*occurrences(part.column(1), p.prefix), p.levels)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(feature.view(np.int64))], names=["doc_id", "feature"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, feature long")


def _marks(docs: DataFrame, features: np.ndarray, p: Severity, fields: list[str]) -> DataFrame:
    """(doc_id, fields): which of the sorted `features` each row has, a bit each in 64-bit words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, p.batch_rows):
                part = batch.slice(at, p.batch_rows)
                owner, feature = presence(*occurrences(part.column(1), p.prefix), p.levels)
                where = np.minimum(np.searchsorted(features, feature), len(features) - 1)
                hit = features[where] == feature
                bits = np.zeros((part.num_rows, 64 * len(fields)), np.uint8)
                bits[owner[hit], where[hit]] = 1
                words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(words[:, k]) for k in range(len(fields)))], names=["doc_id", *fields])

    return docs.select("doc_id", "text").mapInArrow(each, ", ".join(f"{c} long" for c in ("doc_id", *fields)))


@dataclass
class Model:
    """Sorted feature hashes with weights, the thresholds, and the cut of P(grade > 0)."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > g) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def cumulative_loss(x: np.ndarray, grade: np.ndarray, share: np.ndarray, w: np.ndarray, gaps: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Minus the weighted log-likelihood, ridge included, and its slopes by weight and by gap; thresholds are the running sum of `gaps`.

    A row of grade g has log(P(> g - 1) - P(> g)), where P(> -1) is 1 and P(> top) is 0.
    """
    rows = np.arange(len(x))
    above = _logistic((x @ w)[:, None] - np.cumsum(gaps)[None, :])
    sides = np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))])
    upper, lower = sides[rows, grade], sides[rows, grade + 1]
    p = np.maximum(upper - lower, 1e-12)
    g_w = x.T @ (share * (upper + lower - 1)).astype(x.dtype) + l2 * w
    g_t = np.zeros((len(gaps) + 2,))
    # slopes by the threshold below a grade and by the one above it
    np.add.at(g_t, grade, share * upper * (1 - upper) / p)
    np.add.at(g_t, grade + 1, -share * lower * (1 - lower) / p)
    g_gaps = np.cumsum(g_t[1:-1][::-1])[::-1]
    return float(-(share * np.log(p)).sum() + l2 / 2 * (w @ w)), g_w, g_gaps


def fit_cumulative(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by accelerated gradient steps on its weighted likelihood.

    Thresholds are a first one plus positive gaps, so they stay ordered.
    """
    share = weight / weight.sum()
    w, gaps = np.zeros(x.shape[1], np.float32), np.full(grades - 1, 0.5)
    gaps[0] = 1.0
    m, v = np.zeros(len(w) + len(gaps)), np.zeros(len(w) + len(gaps))
    for step in range(1, steps + 1):
        _, g_w, g_gaps = cumulative_loss(x, grade, share, w, gaps, l2)
        g = np.concatenate([g_w, g_gaps]).astype(np.float64)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[: len(w)].astype(np.float32)
        gaps -= move[len(w) :]
        gaps[1:] = np.maximum(gaps[1:], 1e-2)
    return w.astype(np.float64), np.cumsum(gaps)


def decision_cut(probability: np.ndarray, toxic: np.ndarray, recall: float, false_positives: float) -> float:
    """The largest cut up to a half that catches `recall` of the toxic rows, or the least that stays safely within `false_positives` of the clean ones."""
    hits, misses = np.sort(probability[toxic])[::-1], np.sort(probability[~toxic])[::-1]
    if not len(hits) or not len(misses):
        return 0.5
    wanted = hits[max(0, int(np.ceil(recall * len(hits))) - 1)]
    # one standard deviation fewer than wanted, as few clean rows say little about a rate;
    # rows may score like the first clean one that is too many only if they are above it
    wanted_misses = false_positives * len(misses)
    allowed = max(0, int(wanted_misses - wanted_misses**0.5))
    least = np.nextafter(misses[allowed], 1.0) if allowed < len(misses) else 0.0
    return float(min(0.5, max(wanted, least)))


def _surprise(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Likelihood ratio of features held by `a` toxic and `b` clean rows, where `share` of the rows are toxic."""
    part = lambda n, s: np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum((a + b) * s, 1e-300)), 0.0)
    return 2 * (part(a, share) + part(b, 1 - share))


def cross_validated(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, fold: np.ndarray, grades: int, evidence: float, p: Severity) -> tuple[np.ndarray, np.ndarray]:
    """P(grade > 0) of each row by a model whose features and weights come from the other folds, and which rows have one."""
    probability, known, toxic = np.zeros(len(x)), np.zeros(len(x), dtype=bool), grade > 0
    for k in range(p.folds):
        own, rest = fold == k, fold != k
        if not own.any() or not toxic[rest].any() or toxic[rest].all():
            continue
        a, b = x[rest & toxic].sum(axis=0, dtype=np.float64), x[rest & ~toxic].sum(axis=0, dtype=np.float64)
        used = (a + b >= p.least_docs) & (_surprise(a, b, toxic[rest].mean()) >= evidence)
        w, thresholds = fit_cumulative(x[np.ix_(rest, used)], grade[rest], weight[rest], grades, p.l2, p.steps)
        probability[own] = Model(np.empty(0), w, thresholds).probabilities(x[np.ix_(own, used)] @ w)[:, 0]
        known |= own
    return probability, known


def graded(toxic: np.ndarray, score: np.ndarray, grades: int) -> np.ndarray:
    """0 for clean rows, 1 to grades - 1 for toxic ones, in equal parts by `score`."""
    grade = toxic.astype(np.int64)
    if toxic.any():
        for c in np.quantile(score[toxic], np.arange(1, grades - 1) / (grades - 1)):
            grade += toxic & (score > c)
    return grade


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Severity) -> Model | None:
    """The model, from a bounded labelled sample; None where the labels or texts leave nothing to fit.

    Per-class document counts of features are summed in Spark; the driver gets the chosen
    features and, for each sampled row, which of those it has.
    """
    work = Workspace(spark, "severity")
    chosen = work.keep(labelled(labels, "toxic", p.sample), "sample")
    # the classes' shares are those of the labelled rows that are among `docs`
    told = labels.filter("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    totals = {r["label"]: r["count"] for r in told.join(docs.select(F.col("doc_id").cast("long").alias("id")).distinct(), "id").groupBy("label").count().collect()}
    # a bounded number of ids
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "id")), F.col("doc_id") == F.col("id"))
    rows = work.keep(_features(some, p).join(F.broadcast(chosen), "doc_id"), "features")
    sizes = {r["label"]: r["n"] for r in some.groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    counts = rows.groupBy("feature").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    both, share = F.col("a") + F.col("b"), sizes[1] / (sizes[0] + sizes[1])
    surprise = lambda n, s: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (both * s))).otherwise(F.lit(0.0))
    tested = counts.filter(both >= p.least_docs).withColumn("g", 2 * (surprise("a", share) + surprise("b", 1 - share)))
    best = tested.filter(F.col("g") >= min(p.evidence)).orderBy(F.col("g").desc(), "feature").limit(p.features).toPandas()
    if not len(best):
        return None
    features = np.sort(best["feature"].to_numpy(dtype=np.int64).view(np.uint64))
    fields = [f"w{k}" for k in range(-(-len(features) // 64))]
    held = _marks(some, features, p, fields).groupBy("doc_id").agg(*(F.bit_or(w).alias(w) for w in fields))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(p.folds)).cast("int")
    known = held.join(F.broadcast(chosen), "doc_id").withColumn("fold", fold).toPandas()
    label = known["label"].to_numpy()
    words = known[fields].to_numpy(dtype="<i8")
    x = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, : len(features)].astype(np.float32)
    toxic, fold = label == 1, known["fold"].to_numpy()
    weight = np.where(toxic, totals[1] / max(1, toxic.sum()), totals[0] / max(1, (~toxic).sum()))
    binary, _ = cross_validated(x, toxic.astype(np.int64), weight, fold, 2, sorted(p.evidence)[len(p.evidence) // 2], p)
    grade = graded(toxic, binary, p.grades)
    tried = []
    for evidence in p.evidence:
        probability, seen = cross_validated(x, grade, weight, fold, p.grades, evidence, p)
        cut = decision_cut(probability[seen], toxic[seen], p.recall, p.false_positives)
        q = np.clip(np.where(toxic, probability, 1 - probability), 1e-6, 1)
        tried.append((float(np.log(q[seen]) @ weight[seen]), evidence, cut))
    _, evidence, cut = max(tried, key=lambda t: t[0])
    used = _surprise(x[toxic].sum(axis=0, dtype=np.float64), x[~toxic].sum(axis=0, dtype=np.float64), toxic.mean()) >= evidence - 1e-6
    if not used.any():
        return None
    w, thresholds = fit_cumulative(x[:, used], grade, weight, p.grades, p.l2, p.steps)
    work.drop("sample", "features")
    # a row without features is never toxic
    return Model(features[used], w, thresholds, max(cut, float(np.nextafter(_logistic(-thresholds[:1])[0], 1.0))))


def severity(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: Severity | None = None) -> DataFrame:
    """(doc_id, p_toxic, expected_severity, grade, toxic) for each row of `docs` (doc_id, text).

    p_toxic is P(grade > 0), toxic whether it reaches the cut chosen by cross-validation, grade how many thresholds
    are passed with at least a half, and 1 at least for toxic rows. `labels`: doc_id, toxic. Null text has no features; texts of any
    length are read whole. Rows that repeat have equal results. Other columns are not looked at. Where there
    is nothing to fit on, all four are null; an empty table gives no rows.
    """
    p = params or Severity()
    model = fit(spark, docs, labels, p)
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, p_toxic double, expected_severity double, grade int, toxic boolean"
    if model is None:
        return typed.selectExpr("doc_id", "cast(null as double) p_toxic", "cast(null as double) expected_severity", "cast(null as int) grade", "cast(null as boolean) toxic")
    shared = spark.sparkContext.broadcast(model)  # as large as `features` says

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[(known.features >> np.uint64(48)).astype(np.int64)] = True
        bases = np.unique(known.features & _BASE)
        for batch in batches:
            for at in range(0, batch.num_rows, p.batch_rows):
                part = batch.slice(at, p.batch_rows)
                owner, base = occurrences(part.column(1), p.prefix)
                likely = maybe[(base >> np.uint64(48)).astype(np.int64)]
                owner, base = owner[likely], base[likely]
                known_base = np.isin(base & _BASE, bases)
                owner, feature = presence(owner[known_base], base[known_base], p.levels)
                where = np.minimum(np.searchsorted(known.features, feature), len(known.features) - 1)
                hit = known.features[where] == feature
                pairs = np.unique(owner[hit] * len(known.features) + where[hit])
                scores = np.bincount(pairs // len(known.features), weights=known.weights[pairs % len(known.features)], minlength=part.num_rows)
                above = known.probabilities(scores)
                toxic = above[:, 0] >= known.cut
                grade = np.maximum((above >= 0.5).sum(axis=1), toxic)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(toxic)],
                    names=["doc_id", "p_toxic", "expected_severity", "grade", "toxic"],
                )

    return typed.mapInArrow(each, schema)
