from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lodegraph.llm.components import connected_components
from lodegraph.llm.near_dedup import Forest, NearDedup, marked, near_components
from lodegraph.llm.shingles import shingle_sets, text_buffer, word_hashes
from lodegraph.llm.workspace import Workspace

P = NearDedup(words=3, percent=85, matches=16)


def _shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(rows, n, percent):
    """Components by all pairs, rows as (doc_id, text)."""
    sets = [_shingles(t, n) for _, t in rows]
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                label[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def _texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 120))] for _ in range(25)]
    out = []
    for k in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((1000 - k, " ".join(text).title() if k % 5 == 0 else " ".join(text)))
    return out


def test_shingles_are_those_of_the_words():
    texts = ["a b c d", "A  B\tC\nD", "a b", "", None, "é x é x é x", "a b c d a b c"]
    data, offsets = text_buffer(pa.array(texts))
    sets = shingle_sets(*word_hashes(data, offsets), 3)
    assert [len(s) for s in sets] == [len(_shingles(t, 3)) for t in texts]
    assert np.array_equal(sets[0], sets[1]) and set(sets[0]) < set(sets[6])


def test_words_across_slices(monkeypatch):
    from lodegraph.llm import shingles

    texts = ["".join(random.Random(1).choice("ab ") for _ in range(3000)), "x" * 500, "y z"]
    whole = word_hashes(*text_buffer(pa.array(texts)))
    monkeypatch.setattr(shingles, "SLICE_BYTES", 64)
    again = word_hashes(*text_buffer(pa.array(texts)))
    assert np.array_equal(whole[0], again[0]) and np.array_equal(whole[1], again[1])


def test_forest_takes_the_least():
    f = Forest(6)
    f.join(np.array([4, 2, 5]), np.array([2, 0, 3]))
    assert f.label.tolist() == [0, 1, 0, 3, 0, 3]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 230)]
    found = {r.node: r.component for r in connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert found == label


@pytest.mark.parametrize("blocks", [(4096, 1_000_000), (8, 400)])
def test_against_brute_force(spark, make_docs, blocks):
    rows = _texts(7, 160) + [(5, None), (6, ""), (7, "one two"), (8, "ONE\ttwo"), (9, " \n ")]
    p = NearDedup(words=3, percent=85, matches=16, list_block=blocks[0], set_block=blocks[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(spark, make_docs(rows, extra=True), p).collect()}
    assert got == brute(rows, 3, 85)


def test_rows_without_or_with_shared_doc_id(spark, make_docs):
    long = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(None, long), (3, long), (3, other), (2, other), (9, long), (9, long), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_components(spark, make_docs(rows), P).collect()), key=str)
    assert got == sorted([(None, None, True)] * 2 + [(3, 2, False)] * 2 + [(2, 2, True)] + [(9, 2, False)] * 2, key=str)


def test_empty_table(spark, make_docs):
    assert near_components(spark, make_docs([]), P).count() == 0


@pytest.mark.parametrize("name", ["op10_minhash_near_dedup", "fingerprint_components"])
def test_no_table_that_grows_is_broadcast(spark, make_docs, monkeypatch, tmp_path, name):
    from lodegraph.llm import components, near_dedup, queries

    make_docs(_texts(7, 160)).write.parquet(f"{tmp_path}/documents.parquet")
    plans = []
    keep = Workspace.keep

    def seen(self, df, table):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, table)

    monkeypatch.setattr(Workspace, "keep", seen)
    for module in (components, near_dedup):
        monkeypatch.setattr(module, "FEW", -1)
    out = queries.queries()[name](spark, str(tmp_path))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    # the bitmap of clustered documents is bounded
    assert len(joins) > 10 and not [x for x in joins if "Broadcast" in x and "bitmap" not in x and "piece" not in x]


def test_marked_rows_hold_all_wanted(spark):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.col("id").alias("node"), F.lit("t").alias("text")).unionAll(spark.createDataFrame([(None, "x"), (-5, "y"), (-5, "z")], "node long, text string"))
    nodes = docs.filter("node % 10 = 3 or node = -5").select("node")
    work = Workspace(spark, "marked")
    kept = marked(work, docs, nodes)
    assert kept.filter("node % 10 = 3 or node = -5").count() == 2002 and kept.count() < 2002 + 20_000 * 0.2
    assert marked(work, docs, nodes.limit(0)).count() == 0
    # beyond the bitmap's bound nothing is left out
    assert marked(work, docs, nodes, most_bits=100).count() == docs.count()


def _exact_components(rows, words, percent, lower):
    """component by doc_id, from all pairs of texts that share a shingle."""
    import re
    from collections import Counter, defaultdict

    sets = {}
    for doc_id, text in rows:
        text = text or ""
        if lower:
            text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        own = re.findall("[^\\x20\\x09-\\x0D]+", text)
        sets[doc_id] = {tuple(own[k : k + words]) for k in range(len(own) - words + 1)} if len(own) >= words else {tuple(own)} if own else set()
    holders, parent = defaultdict(list), {i: i for i in sets}
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders[s] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("name", ["op10_minhash_near_dedup", "fingerprint_components"])
def test_no_link_is_missed_on_the_corpus(spark, name):
    from lodegraph.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = _exact_components(rows, *((3, 85) if name.startswith("op10") else (5, 80)), lower=True)
    got = {r.doc_id: r.component_id for r in queries.queries()[name](spark, sf).collect()}
    assert got == want and sum(i != c for i, c in want.items()) > 20
