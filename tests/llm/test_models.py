"""Importance resampling, severity and mixing: exact parts against brute force, models on held-out rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import importance, mixing, ngrams, toxicity
from lodegraph.llm.samples import kth_largest, labelled

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    return docs, labels.filter("doc_id % 2 = 0"), {r.doc_id: r for r in labels.filter("doc_id % 2 = 1").collect()}


@pytest.mark.parametrize("values", [[1.0], [3.0, 3.0, 3.0], [float(k % 17) for k in range(3000)], [1e300, -1e300, 0.0, 5.0]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for k in {1, len(values) // 2 or 1, len(values)}:
        assert kth_largest(df, "x", k, bins=8, few=4) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(df, "x", len(values) + 1) is None and kth_largest(df, "x", 0) is None


def test_labelled_is_bounded_and_clean(spark):
    rows = [(k, k % 2) for k in range(50)] + [(None, 1), (3, None), (4, 7), (5, 0), (5, 1)]
    got = labelled(spark.createDataFrame(rows, "doc_id long, quality int"), "quality", 10).collect()
    assert len(got) == 20 and len({r.doc_id for r in got}) == 20


def test_shape_grams_one_a_word():
    texts = pa.array(["Two words", None, "", "HEY HEY hey, 12 x$$", "é"])
    buckets, bounds = ngrams.shape_grams(texts, 16)
    assert np.diff(bounds).tolist() == [2, 0, 0, 5, 1] and len(buckets) == 8
    alone = [ngrams.shape_grams(texts.slice(k, 1), 16)[0].tolist() for k in range(5)]
    assert sum(alone, []) == buckets.tolist()


@pytest.mark.parametrize("text", ["abc", "abcd", "abcdefg"])
def test_byte_grams_stay_in_their_document(text):
    from lodegraph.llm.shingles import text_buffer

    whole, bounds = ngrams.byte_grams(*text_buffer(pa.array([text, "x", "", text, "hello"])), 12)
    alone, _ = ngrams.byte_grams(*text_buffer(pa.array([text])), 12)
    assert whole[bounds[0] : bounds[1]].tolist() == alone.tolist() == whole[bounds[3] : bounds[4]].tolist()
    assert np.diff(bounds).tolist() == [len(alone), 0, 0, len(alone), 2]


def test_best_cut():
    assert importance.best_cut(np.array([1.0, 5.0, 9.0]), np.array([False, True, True])) == 3.0
    assert importance.best_cut(np.array([1.0]), np.array([True])) == -np.inf


def test_resampling_keeps_good_and_rejects_bad(spark, corpus):
    docs, labels, held = corpus
    got = {r.doc_id: r for r in importance.resample(spark, docs, labels).collect()}
    good = [got[i].kept for i, r in held.items() if r.quality == 1]
    bad = [got[i].kept for i, r in held.items() if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.1
    assert got.keys() == {r.doc_id for r in docs.select("doc_id").collect()}


def test_draws_differ_between_seeds_and_follow_the_weights(spark, corpus):
    """On the corpus: with production parameters and with more noise, and how often documents are drawn over many seeds."""
    docs, labels, _ = corpus
    kept, noise_of = {}, lambda ids, seed: importance.gumbel(ids, seed)
    for temperature in (0.25, 4.0):
        rows = importance.resample(spark, docs, labels, importance.Importance(temperature=temperature)).collect()
        ids, x, key = np.array([r.doc_id for r in rows]), np.array([r.mean_weight for r in rows]), np.array([r.gumbel_key for r in rows])
        kept[temperature] = np.array([r.kept for r in rows])
        scale = np.polyfit(noise_of(ids, 17), key - x, 1)[0]
        assert np.allclose(x + scale * noise_of(ids, 17), key)
        k, drawn = int(kept[temperature].sum()), []
        for seed in range(400):
            keys = x + scale * noise_of(ids, seed)
            drawn.append(keys >= np.partition(keys, -k)[-k])
        drawn = np.array(drawn)
        assert (drawn.sum(axis=1) == k).all() and len({d.tobytes() for d in drawn}) > 1
        often = drawn.mean(axis=0)
        some = (often > 0) & (often < 1)
        assert some.any()
        if temperature < 1:
            assert x[often == 1].mean() > x[some].mean() > x[often == 0].mean()
        else:
            # with many documents in doubt the k-th key varies little, so that a document's chance is that of passing it
            level = np.mean([np.partition(x + scale * noise_of(ids, seed), -k)[-k] for seed in range(400)])
            chance = 1 - np.exp(-np.exp(np.clip((x - level) / scale, -40, 40)))
            assert ((chance > 0.02) & (chance < 0.98)).sum() >= 50
            assert np.abs(often - chance).max() < 0.15 and np.abs(often - chance).mean() < 0.02
    other = importance.resample(spark, docs, labels, importance.Importance(temperature=4.0, seed=3)).collect()
    assert {r.doc_id for r in other if r.kept} != set(ids[kept[4.0]].tolist())


def test_equal_rows_far_apart_have_equal_weights(spark, corpus):
    docs, labels, _ = corpus
    some = docs.select("doc_id", "text")
    rows = importance.resample(spark, some.unionAll(some.orderBy("text").coalesce(1)), labels).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add((r.log_weight, r.mean_weight, r.gumbel_key, r.kept))
    assert len(rows) == 2 * len(found) and all(len(v) == 1 for v in found.values())


def test_top_k_against_brute_force(spark, make_docs):
    docs = make_docs([f"Some words {k} here, and more of them." if k % 3 else f"NOISE$$ {k}%% AGAIN!! AND$$ AGAIN!! MORE%%" for k in range(60)] + [(7, "Some words 7 here."), (None, None)], extra=True)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(30)], "doc_id long, quality int")
    rows = importance.resample(spark, docs, labels, importance.Importance(keep=0.5)).collect()
    least = sorted((r.gumbel_key for r in rows), reverse=True)[round(0.5 * len(rows)) - 1]
    assert [r.kept for r in rows] == [r.gumbel_key >= least for r in rows]
    known = [r for r in rows if r.doc_id is not None]
    noise = importance.gumbel(np.array([r.doc_id for r in known]), 17)
    scale = np.polyfit(noise, [r.gumbel_key - r.mean_weight for r in known], 1)[0]
    assert scale > 0 and np.allclose([r.gumbel_key - r.mean_weight for r in known], scale * noise)
    # sixty short texts have too few words for the default smoothing and noise
    kept = importance.keep_good(spark, docs, labels, importance.Importance(smoothing=1.0))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {k for k in range(60) if k % 3}


def test_without_labels_or_documents(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs(["a", None])
    assert all(r.kept for r in importance.resample(spark, docs, none).collect())
    assert [r.toxic for r in toxicity.severity(spark, docs, none).collect()] == [None, None]
    assert [r.rate for r in mixing.mix(spark, docs, none).collect()] == [1.0, 1.0]
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for f in (importance.resample, toxicity.severity, mixing.mix):
        assert f(spark, make_docs([]), labels).count() == 0


def test_severity_on_held_out_rows(spark, corpus):
    docs, labels, held = corpus
    got = {r.doc_id: r for r in toxicity.severity(spark, docs, labels).collect()}
    toxic = [got[i] for i, r in held.items() if r.toxic == 1]
    clean = [got[i] for i, r in held.items() if r.toxic == 0]
    assert np.mean([r.toxic for r in toxic]) > 0.65 and np.mean([r.toxic for r in clean]) < 0.02
    assert np.mean([r.expected_severity for r in toxic]) > 10 * np.mean([r.expected_severity for r in clean])
    assert all(0 <= r.expected_severity <= 3 and 0 <= r.grade <= 3 for r in got.values())


def test_slopes_of_the_cumulative_likelihood():
    rng = np.random.default_rng(5)
    x, grade, share = rng.random((60, 4)), rng.integers(0, 4, 60), np.full(60, 1 / 60)
    w, gaps = rng.normal(size=4), np.array([0.3, 0.5, 0.7])
    loss = lambda w, gaps: toxicity.cumulative_loss(x, grade, share, w, gaps, 1e-2)
    at, g_w, g_gaps = loss(w, gaps)
    e = 1e-6
    assert np.allclose(g_w, [(loss(w + e * d, gaps)[0] - at) / e for d in np.eye(4)], atol=1e-5)
    assert np.allclose(g_gaps, [(loss(w, gaps + e * d)[0] - at) / e for d in np.eye(3)], atol=1e-5)
    above = lambda row, g: 1.0 if g < 0 else 0.0 if g > 2 else 1 / (1 + np.exp(np.cumsum(gaps)[g] - row @ w))
    plain = -sum(s * np.log(above(row, g - 1) - above(row, g)) for row, g, s in zip(x, grade, share, strict=True)) + 0.005 * w @ w
    assert np.isclose(at, plain)


def test_grades_split_toxic_rows_evenly():
    toxic = np.array([True] * 9 + [False] * 3)
    assert toxicity.graded(toxic, np.r_[np.arange(9), 100, 100, 100], 4).tolist() == [1] * 3 + [2] * 3 + [3] * 3 + [0] * 3
    assert toxicity.graded(~toxic[:0], np.zeros(0), 4).tolist() == []


def test_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    x = (rng.random((300, 5)) < 0.4).astype(np.float32)
    grade = np.clip((x @ np.array([2, 1, 0, 0, 0])).astype(int), 0, 3)
    w, t = toxicity.fit_cumulative(x, grade, np.ones(300), 4, 1e-3, 300)
    assert (np.diff(t) >= 0).all() and w[0] > w[1] > np.abs(w[2:]).max()


def test_severity_with_odd_rows(spark, make_docs):
    docs = make_docs([f"nasty filth {k}" if k % 2 else f"kind words {k}" for k in range(40)] + [(40, None), (3, "nasty filth 3"), (None, "nasty filth")], extra=True)
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.severity(spark, docs, labels).collect()
    assert len(got) == 43
    assert all(r.toxic == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 40)
    assert [r.toxic for r in got if r.doc_id is None] == [True] and [r.toxic for r in got if r.doc_id == 40] == [False]


def test_draws_follow_the_weights():
    """Gumbel top-k with k = 1 draws each row with a chance in proportion to exp(weight)."""
    weight = np.log([1.0, 2.0, 3.0, 4.0])
    first = [int(np.argmax(weight + importance.gumbel(np.arange(4), seed))) for seed in range(20_000)]
    assert np.abs(np.bincount(first, minlength=4) / len(first) - np.array([0.1, 0.2, 0.3, 0.4])).max() < 0.02


def test_noise_without_doc_id_is_by_text():
    import pyarrow as pa

    keys = importance.keys_of(pa.array([None, None, 3, None], pa.int64()), pa.array(["a", "b", "c", "a"]))
    assert keys[0] == keys[3] != keys[1] and keys[2] == 3


def test_log_ratios_against_plain_counts():
    target, raw = np.array([[8.0, 0.0, 2.0]]), np.array([[10.0, 80.0, 10.0]])
    assert np.allclose(importance.log_ratios(target, raw, 1.0), np.log([[9 / 2, 1 / 9, 3 / 2]]))


def test_words_and_pairs():
    import pyarrow as pa

    from lodegraph.llm.ngrams import word_grams

    grams, bounds = word_grams(pa.array(["a b a b", "A B", None, "c"]), 16)
    assert bounds.tolist() == [0, 8, 12, 12, 14]
    assert grams[0:4].tolist() == grams[8:12].tolist() == [grams[4], grams[1], grams[2], grams[7]]


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    posterior = rng.dirichlet([0.3, 0.3, 0.3], 400)
    tokens = rng.integers(1, 200, 400)
    table = spark.createDataFrame([(int(t), [float(v) for v in row]) for t, row in zip(tokens, posterior, strict=True)], "tokens long, posterior array<double>")
    for p in (mixing.Mixing(targets={"a": 0.5, "b": 0.3, "c": 0.2}), mixing.Mixing(targets={"a": 0.8, "b": 0.1, "c": 0.1}, total=20_000.0), mixing.Mixing(targets={"a": 0.6, "b": 0.4, "c": None}, least=1.0, spare=0.1)):
        fit = mixing.fit_rates(table, p)
        best = posterior.argmax(axis=1)
        low = np.where((best < 2) if p.targets["c"] is None else True, p.least, 0.0)
        rates = np.clip(1 + posterior @ fit.y, low, p.most)
        assert fit.converged and fit.residual < 1e-6
        assert np.allclose(fit.reached, (rates * tokens) @ posterior)
        assert np.allclose([r[0] for r in table.select(mixing.rate(fit.y, p)).collect()], rates)


def test_targets_out_of_reach_end_with_a_warning_or_an_error(spark, caplog):
    table = spark.createDataFrame([(10, [0.5, 0.5]), (20, [0.6, 0.4])], "tokens long, posterior array<double>")
    wanted = {"a": 0.1, "b": 0.9}
    assert mixing.fit_rates(table, mixing.Mixing(targets=wanted, total=30.0, rounds=3)).residual > 0.1
    with pytest.raises(RuntimeError, match="not converged"):
        mixing.fit_rates(table, mixing.Mixing(targets=wanted, total=30.0, rounds=0, strict=True))
    assert mixing.fit_rates(table.limit(0), mixing.Mixing(targets=wanted)).converged


def test_mixing_on_the_corpus(spark, corpus):
    docs, labels, held = corpus
    p = mixing.Mixing()
    got = mixing.mix(spark, docs, labels, p).toPandas()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    guess = got.set_index("doc_id")[[f"p_{d}" for d in p.targets]].to_numpy().argmax(axis=1)
    at = {i: g for i, g in zip(got["doc_id"], guess, strict=True)}
    right = [list(p.targets)[at[i]] == (lang[i] if r.quality == 1 else "low") for i, r in held.items()]
    assert np.mean(right) > 0.97
    total = np.array([(got["rate"] * got["tokens"] * got[f"p_{d}"]).sum() for d in p.targets])
    share = np.array(list(p.targets.values())) / sum(p.targets.values())
    assert np.abs(total / total.sum() - share).max() < 1e-6 and (got["rate"] >= 0).all()


def test_copies_follow_rates(spark, make_docs):
    rng = random.Random(1)
    word = lambda a: "".join(rng.choice(a) for _ in range(5))
    texts = [" ".join(word("abcde") if k % 4 else word("vwxyz") for _ in range(20)) for k in range(200)]
    docs = make_docs([*texts, (None, None), (3, "")]).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, "de").otherwise("en"))
    labels = spark.createDataFrame([(k, 1) for k in range(150)], "doc_id long, quality int")
    p = mixing.Mixing(targets={"en": 0.5, "de": 0.5, "low": 0.0})
    out = mixing.mixed_documents(spark, docs, labels, p)
    assert out.columns == docs.columns
    n = {r["lang"]: r["n"] for r in out.filter("text <> ''").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert 0.8 < n["de"] / n["en"] < 1.25 and n["en"] >= 145


def test_decision_cut():
    cut = lambda hits, misses, recall, fp: toxicity.decision_cut(np.array(hits + misses), np.arange(len(hits) + len(misses)) < len(hits), recall, fp)
    assert cut([0.9, 0.8, 0.3, 0.2], [0.1, 0.05], 0.75, 0.0) == 0.3 and cut([0.9, 0.8], [0.1], 1.0, 0.0) == 0.5
    assert 0.25 < cut([0.9, 0.3, 0.2], [0.25, 0.1], 1.0, 0.0) < 0.3 and cut([0.9, 0.3, 0.2], [0.25, 0.22, *[0.1] * 6], 1.0, 0.5) == 0.2
    # of two clean rows none may be lost, though one would be half of them
    assert 0.25 < cut([0.9, 0.3, 0.2], [0.25, 0.1], 1.0, 0.5) < 0.3
    assert cut([], [0.3], 1.0, 0.0) == cut([0.3], [], 1.0, 0.0) == 0.5


def test_cut_catches_held_out_toxic_rows(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    held = read("labels").filter("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("said")).distinct()
    got = toxicity.severity(spark, read("documents"), read("labels").filter("doc_id % 2 = 0")).join(held, "doc_id").toPandas()
    assert got["toxic"][got["said"] == 1].mean() > 0.9 and got["toxic"][got["said"] == 0].mean() < 0.015
    assert ((got["grade"] > 0) == got["toxic"]).all()
    # held-out severity orders grades, and toxic rows above clean ones
    mean = got.groupby("grade")["expected_severity"].mean()
    assert mean.is_monotonic_increasing and got["expected_severity"][got["said"] == 1].mean() > 20 * got["expected_severity"][got["said"] == 0].mean()


def test_features_count_beginnings():
    texts = pa.array(["Stemming stems stemmed, and stemless", None, "and", "stem stems"])
    owner, feature = toxicity.presence(*toxicity.occurrences(texts, 4), 3)
    levels = lambda d: sorted(int(f & np.uint64(3)) for o, f in zip(owner, feature, strict=True) if o == d)
    # five words; `stem` at three levels, `and` at one
    assert levels(0) == [0] * 5 + [1, 1, 2, 3] and levels(1) == [] and levels(2) == [0, 1] and levels(3) == [0, 0, 1, 2]
    assert len(set(zip(owner.tolist(), feature.tolist(), strict=True))) == len(owner)
    one = lambda d, level: {int(f) for o, f in zip(owner, feature, strict=True) if o == d and f & np.uint64(3) == level}
    assert one(3, 2) <= one(0, 2) and one(2, 0) <= one(0, 0) and one(2, 1) <= one(0, 1)


def test_class_shares_are_those_of_the_documents_at_hand(spark, corpus):
    """Labels of documents that are not there change nothing."""
    docs, labels, _ = corpus
    some = docs.filter("doc_id < 600")
    all_ = {r.doc_id: tuple(r) for r in toxicity.severity(spark, some, labels).collect()}
    own = {r.doc_id: tuple(r) for r in toxicity.severity(spark, some, labels.filter("doc_id < 600")).collect()}
    assert all_ == own
