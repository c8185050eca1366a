from __future__ import annotations

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A small corpus: clean prose in copies, near copies and with private data, and noise."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8)))
    prose = [" ".join(word() for _ in range(60)).capitalize() + "." for _ in range(80)]
    rows = [(k, t) for k, t in enumerate(prose)]
    rows += [(100 + k, prose[k]) for k in range(10)] + [(200 + k, prose[k] + " extra") for k in range(10)]
    rows += [(300, prose[11] + " mail me@site.example.com now"), (301, None), (302, "")]
    rows += [(400 + k, " ".join(word().upper() + "$$!!" for _ in range(50))) for k in range(20)]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 80, 2)] + [(400 + k, 0, 0) for k in range(0, 20, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        seen.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = spark.createDataFrame(seen[-1], docs.schema)
    quality, near, private, mixed, tokens = ({r.doc_id for r in rows} for rows in seen)
    assert quality == {*range(80), *range(100, 110), *range(200, 210), 300, 301, 302}
    # a copy with a few more words goes too
    assert near == quality - {*range(100, 110), *range(200, 210), 300}
    assert private == near and mixed == near and tokens == near
    assert not any("@" in (r.text or "") for r in seen[2])
    got = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in got.collect()} == tokens and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_broadcast_bounded_tables_only(spark, sf_dir, monkeypatch):
    from lodegraph.llm import components, near_dedup
    from lodegraph.llm.workspace import Workspace

    plans = []
    keep = Workspace.keep

    def seen(self, df, table):
        plans.append((table, df._jdf.queryExecution().executedPlan().toString()))
        return keep(self, df, table)

    monkeypatch.setattr(Workspace, "keep", seen)
    for module in (components, near_dedup):
        monkeypatch.setattr(module, "FEW", -1)
    corpus_pipeline.run(spark, sf_dir).collect()
    assert {t for t, _ in plans} >= {"clusters", "placed", "stage1", "present", "stage3"}
    # the bitmap of clustered documents is bounded
    found = [x for t, plan in plans for x in plan.splitlines() if "BroadcastHashJoin" in x and "piece" not in x and "bitmap" not in x]
    assert not found


def test_mixture_keeps_wanted_documents(spark, make_docs, tmp_path):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    word = lambda a: "".join(rng.choice(a) for _ in range(5))
    alphabets = {"en": "abcdef", "de": "cdefgh", "fr": "efghij", "es": "ghijkl"}
    lang = [list(alphabets)[k % 4] for k in range(200)]
    docs = make_docs([" ".join(word(alphabets[x]) for _ in range(20)) for x in lang] + [(200 + k, " ".join(word("abcdef") for _ in range(20))) for k in range(2)])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") >= 200, "en").otherwise(F.element_at(F.array(*map(F.lit, alphabets)), (F.col("doc_id") % 4 + 1).cast("int"))))
    # of many low rows an earlier stage has left two, which read like the good ones
    labels = [(k, 1) for k in range(0, 200, 2)] + [(k, 0) for k in range(200, 1200)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.mixture(spark, docs, str(tmp_path)).collect()}
    assert kept >= {*range(200)}
