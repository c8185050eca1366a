from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import identity


def _one(spark, values, column):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("x"))).collect()]


def test_normalized_image(spark):
    cases = {
        "alpine": "docker.io/library/alpine",
        "alpine:3.19": "docker.io/library/alpine",
        "alpine@sha256:ab": "docker.io/library/alpine",
        "alpine:3@sha256:ab": "docker.io/library/alpine",
        "team/tool:1": "docker.io/team/tool",
        "GHCR.io/Team/Tool:1": "ghcr.io/Team/Tool",
        "localhost/x": "localhost/x",
        "reg:5000/x:2": "reg:5000/x",
        "docker.io/redis": "docker.io/library/redis",
        " a.b/c ": "a.b/c",
        "": "",
    }
    assert _one(spark, cases, identity.normalized_image) == list(cases.values())


def test_image_identity_and_version(spark):
    refs = ["reg/x:1", "reg/x", "reg:80/x", "reg:80/x:2", "x@sha256:ab", "x:1@sha256:ab"]
    kind = F.lit("container_image")
    assert _one(spark, refs, lambda c: identity.identity_key(kind, c)) == ["reg/x", "reg/x", "reg:80/x", "reg:80/x", "x", "x:1"]
    assert _one(spark, refs, lambda c: identity.version(kind, c)) == ["1", "", "", "2", "sha256:ab", "sha256:ab"]


def test_module_identity_and_version(spark):
    refs = ["a.b/c@v1", "a.b/c", "a.b/c/v2", "a@b@c"]
    kind = F.lit("go_module")
    assert _one(spark, refs, lambda c: identity.identity_key(kind, c)) == ["a.b/c", "a.b/c", "a.b/c/v2", "a"]
    assert _one(spark, refs, lambda c: identity.version(kind, c)) == ["v1", "", "", "b@c"]
    assert _one(spark, ["x@1"], lambda c: identity.identity_key(F.lit("service"), c)) == ["x@1"]


def test_workflow_image_needs_a_host(spark):
    refs = ["alpine:3", "team/tool", "GHCR.io/T/x:1", "localhost/x@sha256:a", "a.b/c d", "", "h:1/x"]
    assert _one(spark, refs, identity.workflow_image) == [None, None, "ghcr.io/T/x", "localhost/x", None, None, "h:1/x"]


def test_module_refs_add_the_owning_repository(spark):
    paths = ["github.com/a/b/c", "github.com/a/b", "example.com/a/b/c", " ", "gitlab.com/a"]
    assert _one(spark, paths, identity.module_refs) == [["github.com/a/b/c", "github.com/a/b"], ["github.com/a/b"], ["example.com/a/b/c"], [], ["gitlab.com/a"]]


def test_node_ids_are_stable(spark):
    df = spark.createDataFrame([("go_module", "bufio"), ("cli_binary", "git")], "kind string, ref string")
    ids = [tuple(r) for r in df.select(identity.node_id(F.col("kind"), F.col("ref")), identity.kind_node_id(F.col("kind"))).collect()]
    assert ids == [("n89b362ba6a29", "k180db655"), ("nc086671ddc65", "k01708225")]


@pytest.mark.parametrize(("a", "b", "match"), [("1", "1", "exact"), ("", "", "exact"), ("1", "", "unknown"), ("1", "2", "mismatch")])
def test_version_match(spark, a, b, match):
    assert spark.range(1).select(identity.version_match(F.lit(a), F.lit(b))).first()[0] == match
