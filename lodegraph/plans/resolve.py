"""Consumers joined to producers: resolved edges, external consumers, dangling producers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import identity
from lodegraph.functions.text import stripped
from lodegraph.schema import CONSUMER, DANGLING, EXTERNAL, PRODUCER, RESOLVED

EDGE_ORDER = ("kind", "p_ref", "c_ref", "p_file", "p_line", "c_file", "c_line")
LEFT_ORDER = ("kind", "ref", "file", "line")


def canonical(facts: DataFrame) -> DataFrame:
    """Facts with identity_key and version; references trimmed."""
    ref = stripped(F.col("ref"))
    keyed = facts.withColumn("ref", ref)
    return keyed.withColumn("identity_key", identity.identity_key(F.col("kind"), F.col("ref"))).withColumn("version", identity.version(F.col("kind"), F.col("ref")))


def _side(facts: DataFrame, role: str) -> DataFrame:
    return canonical(facts.filter(F.col("role") == role)).select("kind", "ref", "file", "line", "identity_key", "version")


def resolved_edges(facts: DataFrame) -> DataFrame:
    """Every producer with every consumer of the same kind and identity, with how their versions match."""
    p = _side(facts, PRODUCER).withColumnsRenamed({c: f"p_{c}" for c in ("ref", "file", "line", "version")})
    c = _side(facts, CONSUMER).withColumnsRenamed({c: f"c_{c}" for c in ("ref", "file", "line", "version")})
    match = identity.version_match(F.col("p_version"), F.col("c_version"))
    return c.join(p, ["kind", "identity_key"]).select("kind", "p_ref", "p_file", "p_line", "c_ref", "c_file", "c_line", match.alias("version_match"))


def _unmatched(facts: DataFrame, role: str, other: str) -> DataFrame:
    return _side(facts, role).join(_side(facts, other), ["kind", "identity_key"], "left_anti").select("kind", "ref", "file", "line")


def external(facts: DataFrame) -> DataFrame:
    """Consumers that nothing produces."""
    return _unmatched(facts, CONSUMER, PRODUCER)


def dangling(facts: DataFrame) -> DataFrame:
    """Producers that nothing consumes."""
    return _unmatched(facts, PRODUCER, CONSUMER)


def bucket_counts(facts: DataFrame) -> DataFrame:
    """(bucket, version_match, n). Pairs are counted by key, so edges are not built for it."""
    one = lambda role, n, v: _side(facts, role).groupBy("kind", "identity_key", F.col("version").alias(v)).agg(F.count("*").alias(n))
    p, c = one(PRODUCER, "np", "pv"), one(CONSUMER, "nc", "cv")
    keys = ["kind", "identity_key"]
    edges = p.join(c, keys).groupBy(identity.version_match(F.col("pv"), F.col("cv")).alias("version_match")).agg(F.sum(F.col("np") * F.col("nc")).alias("n"))
    left = lambda a, b, n, bucket: a.join(b, keys, "left_anti").agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).select(F.lit(bucket).alias("bucket"), F.lit("").alias("version_match"), "n")
    return edges.select(F.lit("resolved").alias("bucket"), "version_match", "n").unionAll(left(c, p, "nc", "external")).unionAll(left(p, c, "np", "dangling"))


def root_labels(roots: DataFrame) -> DataFrame:
    """(root, label): base names; of roots with one base name, in order, all but the first get ~1, ~2 and so on."""
    base = F.element_at(F.split(F.regexp_replace("root", "/+$", ""), "/"), -1)
    named = roots.select("root", F.when(base.isin("", "."), F.lit("root")).otherwise(base).alias("base")).distinct()
    at = F.row_number().over(Window.partitionBy("base").orderBy("root")) - 1
    return named.select("root", F.when(at > 0, F.concat_ws("~", "base", at.cast("string"))).otherwise(F.col("base")).alias("label"))


def longest_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(file, root): for each distinct file the longest root that is it or a folder above it; files of none are left out.

    A file's own folder prefixes are joined on, so cost grows with path depth and not
    with the number of roots.
    """
    distinct = files.select("file").distinct()
    parts = F.split("file", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = distinct.select("file", F.explode(prefixes).alias("root"))
    return each.join(roots.select("root").distinct(), "root").groupBy("file").agg(F.max_by("root", F.octet_length("root")).alias("root"))


def repo_edges(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """(from_label, to_label, n): edges between roots, consumer to producer; edges within a root have n too, the diagram leaves them out.

    Facts are counted by identity and root before they are joined, so edges are not built.
    """
    known = canonical(facts).groupBy("role", "kind", "identity_key", "file").agg(F.count("*").alias("n"))
    at = longest_roots(known, roots).join(root_labels(roots), "root").select("file", "label")
    placed = known.join(at, "file").groupBy("role", "kind", "identity_key", "label").agg(F.sum("n").alias("n"))
    side = lambda role, label, n: placed.filter(F.col("role") == role).select("kind", "identity_key", F.col("label").alias(label), F.col("n").alias(n))
    both = side(PRODUCER, "to_label", "np").join(side(CONSUMER, "from_label", "nc"), ["kind", "identity_key"])
    return both.groupBy("from_label", "to_label").agg(F.sum(F.col("np") * F.col("nc")).alias("n"))


def artifacts(facts: DataFrame) -> DataFrame:
    """Distinct (kind, ref, bucket): resolved if its identity is produced and consumed, else external or dangling.

    Made of distinct references and identities, not of edges.
    """
    has = lambda role: F.max(F.col("role") == role)
    refs = canonical(facts).groupBy("kind", "identity_key", "ref").agg(has(PRODUCER).alias("produced"), has(CONSUMER).alias("consumed"))
    keys = refs.groupBy("kind", "identity_key").agg(F.max("produced").alias("produced"), F.max("consumed").alias("consumed"))
    bucket = F.when(F.col("produced") & F.col("consumed"), RESOLVED).when(F.col("consumed"), EXTERNAL).otherwise(DANGLING)
    return refs.select("kind", "identity_key", "ref").join(keys, ["kind", "identity_key"]).select("kind", "ref", bucket.alias("bucket"))


def nodes(found: DataFrame) -> DataFrame:
    """(kind, ref, bucket) once for each of `found` (kind, ref, bucket); resolved wins over external over dangling."""
    rank = F.when(F.col("bucket") == RESOLVED, 0).when(F.col("bucket") == EXTERNAL, 1).otherwise(2)
    return found.groupBy("kind", "ref").agg(F.min_by("bucket", rank).alias("bucket"))
