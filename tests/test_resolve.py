from __future__ import annotations

from lodegraph import schema
from lodegraph.plans import resolve


def _facts(spark, rows):
    return spark.createDataFrame([(role, "t", "r", kind, ref, file, line) for role, kind, ref, file, line in rows], schema.FACTS)


ROWS = [
    ("producer", "container_image", "x:1", "a/Dockerfile", 1),
    ("consumer", "container_image", "x:2", "b/Dockerfile", 2),
    ("consumer", "container_image", "x", "b/sub/Dockerfile", 3),
    ("producer", "container_image", "y", "a/Dockerfile", 4),
    ("consumer", "go_module", "x", "b/go.mod", 5),
    ("producer", "go_module", "m/v2", "a/go.mod", 6),
    ("consumer", "go_module", "m", "b/go.mod", 7),
]


def test_buckets(spark):
    f = _facts(spark, ROWS)
    edges = [(r.p_ref, r.c_ref, r.version_match) for r in resolve.resolved_edges(f).orderBy(*resolve.EDGE_ORDER).collect()]
    assert edges == [("x:1", "x", "unknown"), ("x:1", "x:2", "mismatch")]
    assert {r.ref for r in resolve.external(f).collect()} == {"x", "m"}
    assert {r.ref for r in resolve.dangling(f).collect()} == {"y", "m/v2"}
    counts = {(r.bucket, r.version_match): r.n for r in resolve.bucket_counts(f).collect()}
    assert counts == {("resolved", "unknown"): 1, ("resolved", "mismatch"): 1, ("external", ""): 2, ("dangling", ""): 2}


def test_many_to_many_is_a_bag(spark):
    f = _facts(spark, [("producer", "service", "s", "a", k) for k in range(2)] + [("consumer", "service", "s", "b", k) for k in range(3)])
    assert resolve.resolved_edges(f).count() == 6


def test_no_facts(spark):
    f = _facts(spark, [])
    assert resolve.resolved_edges(f).count() == 0
    assert sorted((r.bucket, r.n) for r in resolve.bucket_counts(f).collect()) == [("dangling", 0), ("external", 0)]


def test_longest_root_and_labels(spark):
    roots = spark.createDataFrame([("a",), ("a/b",), ("c/b",), (".",)], "root string")
    files = spark.createDataFrame([("a/b/x",), ("a/bx",), ("a/b",), ("z",)], "file string")
    assert {r.file: r.root for r in resolve.longest_roots(files, roots).collect()} == {"a/b/x": "a/b", "a/bx": "a", "a/b": "a/b"}
    assert {r.root: r.label for r in resolve.root_labels(roots).collect()} == {"a": "a", "a/b": "b", "c/b": "b~1", ".": "root"}


def test_repo_edges(spark):
    f = _facts(spark, ROWS)
    roots = spark.createDataFrame([("a",), ("b",), ("b/sub",)], "root string")
    found = {(r.from_label, r.to_label): r.n for r in resolve.repo_edges(f, roots).collect()}
    assert found == {("b", "a"): 1, ("sub", "a"): 1}


def test_resolved_wins_over_other_buckets(spark):
    f = _facts(spark, [("producer", "container_image", "x:1", "a", 1), ("consumer", "container_image", "x:1", "b", 1), ("consumer", "service", "q", "b", 1)])
    nodes = {(r.kind, r.ref): r.bucket for r in resolve.nodes(resolve.artifacts(f)).collect()}
    assert nodes == {("container_image", "x:1"): "resolved", ("service", "q"): "external"}
    both = spark.createDataFrame([("k", "r", "dangling"), ("k", "r", "resolved"), ("k", "s", "dangling"), ("k", "s", "external")], "kind string, ref string, bucket string")
    assert {(r.ref, r.bucket) for r in resolve.nodes(both).collect()} == {("r", "resolved"), ("s", "external")}
