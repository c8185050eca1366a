from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.functions import text
from lodegraph.plans import coverage, report, similarity


def _entities(spark, rows):
    return spark.createDataFrame([(k, name, "function", package, "p/f.go", True, doc) for k, (name, package, doc) in enumerate(rows)], schema.ENTITIES)


def _refs(spark, texts):
    return spark.createDataFrame([(k, t, "code_span", "d.md", k) for k, t in enumerate(texts)], schema.DOC_REFS)


def _tokens(spark, words):
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string")
    return [r[0] for r in df.orderBy("k").select(text.tokens(F.col("w"))).collect()]


def test_tokens(spark):
    cases = {"HTTPServer": ["http", "server"], "parseGoMod": ["parse", "go", "mod"], "a.b_c-d/e:f(g)": list("abcdefg"), "v2Api": ["v", "2", "api"], "": [], "x\ty": ["x\ty"], "ÉtéBleu": ["été", "bleu"]}
    assert _tokens(spark, cases) == list(cases.values())


def test_sets_and_likeness(spark):
    row = spark.sql("select 'getUserById' a, 'getUser' b").select(text.token_set(F.col("a")), text.trigrams(F.lit("abc ab")), text.jaccard(F.lit(3), F.lit(4), F.lit(3)), text.dice(F.lit(0), F.lit(0), F.lit(3)), text.jaccard(F.lit(0), F.lit(0), F.lit(0))).first()
    assert (row[0], row[1]) == (["get", "user", "by", "id"], ["abc"])
    assert (row[2], row[3], row[4]) == (0.75, 0.0, 0.0)


def test_predicates(spark):
    df = spark.createDataFrame([("Abc.d_1",), ("1a",), ("a b",), ("-x",), ("É",), ("é",), ("",)], "x string")
    x = F.col("x")
    found = [tuple(r) for r in df.select(text.looks_like_identifier(x), text.common_non_identifier(x), text.exported(x)).collect()]
    assert found == [(True, False, True), (False, False, False), (False, True, False), (False, True, False), (False, False, True), (False, False, True), (False, False, False)]


def test_cascade_and_summary(spark):
    e = _entities(spark, [("ParseFile", "go", ""), ("RenderDiagram", "go", ""), ("Zed", "q", "walks every source folder"), ("Quux", "", ""), ("ParseFile", "other", "")])
    r = _refs(spark, [" ParseFile() ", "go.RenderDiagram", "renderDiagrams", "diagram_render", "walks source folder", "nothing", "nothing"])
    c = coverage.compute(e, r)
    layers = {m.norm: (m.layer, m.ord) for m in c.matches.collect()}
    assert layers["ParseFile"] == ("exact", 4)
    assert layers["go.RenderDiagram"] == ("exact", 1)
    assert layers["diagram_render"] == ("jaccard", 1)
    assert layers["renderDiagrams"][0] in ("jaccard", "trigram")
    assert layers["walks source folder"] == ("doc", 2)
    assert "nothing" not in layers
    s = c.summary().first()
    assert (s["entities"], s["covered"], s["refs"], s["stale"], s["packages"], s["doc_files"]) == (5, 4, 7, 2, 4, 1)
    assert {x.name for x in c.uncovered.collect()} == {"Quux"}
    body = report.coverage_text(c, verbose=True).text()
    assert "Coverage:  4/5 (80.0%)" in body and "Uncovered (1):" in body and "`nothing`  d.md:5" in body
    assert '"total_entities": 5' in report.coverage_json(c).text()


def test_exact_only_without_threshold(spark):
    e = _entities(spark, [("ParseFile", "go", "")])
    assert coverage.compute(e, _refs(spark, ["parseFile", "ParseFile"]), 0).stale.count() == 1


def test_gate(spark):
    c = coverage.compute(_entities(spark, [(f"E{k:02}", "p", "") for k in range(12)]), _refs(spark, ["E00"]), 0)
    coverage.gate(c, max_uncovered=11)
    with pytest.raises(coverage.GateError, match=r"11 uncovered entities \(budget 3\): p.E01, .*p.E10 \(\+1 more\)"):
        coverage.gate(c, max_uncovered=3)
    with pytest.raises(coverage.GateError, match="below floor 0.5000"):
        coverage.gate(c, min_coverage=0.5)
    coverage.gate(coverage.compute(_entities(spark, []), _refs(spark, ["x"])), max_uncovered=0)


def test_merge_keeps_the_first(spark):
    a, b = _refs(spark, ["x", "y"]), _refs(spark, ["x", "z"])
    assert [(r.source, r.text) for r in coverage.merge_refs(a, b).orderBy("source", "ord").collect()] == [(0, "x"), (0, "y"), (1, "z")]


@pytest.mark.parametrize(("measure", "threshold"), [("jaccard", 0.4), ("jaccard", 1.0), ("dice", 0.3)])
def test_similar_pairs_against_brute_force(spark, measure, threshold):
    import random

    rng = random.Random(5)
    sets = [sorted({f"t{min(rng.randrange(12), rng.randrange(12))}" for _ in range(rng.randrange(0, 7))}) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, items array<string>")
    got = {(r.left_id, r.right_id): round(r.sim, 9) for r in similarity.similar_pairs(df, df, measure, threshold).collect()}
    want = {}
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            common = len(set(x) & set(y))
            if common:
                sim = common / (len(x) + len(y) - common) if measure == "jaccard" else 2 * common / (len(x) + len(y))
                if sim >= threshold:
                    want[i, j] = round(sim, 9)
    assert got == want


def test_bitmaps_leave_few_false_candidates(spark):
    """Names of parts at the cascade's trigram threshold: candidates with bitmaps hold all pairs, and a tenth of those that are none."""
    from lodegraph import queries

    sf = "/root/testdata/sf0.001"
    side = lambda df, key, c: similarity._sets(similarity._members(df.select(F.col(key).alias("id"), text.trigrams(F.col(c)).alias("items"))))
    left = side(queries.doc_refs(spark, sf).select(F.col("ord"), "text"), "ord", "text")
    right = side(queries.entities(spark, sf), "ord", "name")
    t = similarity._as_jaccard("dice", coverage.TRIGRAM_THRESHOLD) - 1e-9
    all_ = {tuple(r) for r in similarity._candidates(left, right, t, bounded=False).collect()}
    few = {tuple(r) for r in similarity._candidates(left, right, t).collect()}
    sets = [{r.key: set(r["items"]) for r in df.collect()} for df in (left, right)]
    near = {(a, b) for a, x in sets[0].items() for b, y in sets[1].items() if 2 * len(x & y) >= coverage.TRIGRAM_THRESHOLD * (len(x) + len(y))}
    assert near <= few <= all_ and len(few - near) * 10 < len(all_ - near), (len(near), len(few), len(all_))
