"""Artifact identities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.functions.text import stripped

#: Hosts whose first three path segments name a repository.
REPO_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
DEFAULT_REGISTRY, OFFICIAL = "docker.io", "library"


def _after(c: Column, mark: str) -> Column:
    """What follows the first `mark`; empty without."""
    return F.regexp_extract(c, f"(?s)^[^{mark}]*{mark}(.*)$", 1)


def without_tag(ref: Column) -> Column:
    """Without what follows a colon after the last slash."""
    return F.regexp_replace(ref, r":[^/:]*$", "")


def identity_key(kind: Column, ref: Column) -> Column:
    """The part of a reference that versions share."""
    image = F.when(F.contains(ref, F.lit("@")), F.substring_index(ref, "@", 1)).otherwise(without_tag(ref))
    return F.when(kind == schema.GO_MODULE, F.substring_index(ref, "@", 1)).when(kind == schema.IMAGE, image).otherwise(ref)


def version(kind: Column, ref: Column) -> Column:
    """The rest: after the first @, or an image's tag; empty without."""
    pinned = _after(ref, "@")
    image = F.when(F.contains(ref, F.lit("@")), pinned).otherwise(F.regexp_extract(ref, r":([^/:]*)$", 1))
    return F.when(kind == schema.GO_MODULE, pinned).when(kind == schema.IMAGE, image).otherwise(F.lit(""))


def _is_host(first: Column) -> Column:
    return first.rlike("[.:]") | (first == "localhost")


def normalized_image(raw: Column) -> Column:
    """registry/repository of an image reference without tag and digest, with the default registry and namespace filled in."""
    ref = without_tag(F.substring_index(stripped(raw), "@", 1))
    first = F.substring_index(ref, "/", 1)
    hosted = F.contains(ref, F.lit("/")) & _is_host(first)
    registry = F.lower(F.when(hosted, first).otherwise(F.lit(DEFAULT_REGISTRY)))
    repository = F.when(hosted, _after(ref, "/")).otherwise(ref)
    official = (registry == DEFAULT_REGISTRY) & ~F.contains(repository, F.lit("/"))
    full = F.concat(registry, F.lit("/"), F.when(official, F.concat(F.lit(f"{OFFICIAL}/"), repository)).otherwise(repository))
    return F.when(stripped(raw) == "", F.lit("")).otherwise(full)


def workflow_image(raw: Column) -> Column:
    """An image reference of a workflow, host in lower case, without tag and digest; null where it isn't one with a host."""
    ref = stripped(raw)
    repo = without_tag(F.substring_index(ref, "@", 1))
    host = F.substring_index(repo, "/", 1)
    fits = (ref != "") & ~ref.rlike("[ \\t]") & F.contains(repo, F.lit("/")) & _is_host(host)
    return F.when(fits, F.concat(F.lower(host), F.lit("/"), _after(repo, "/")))


def owning_repo(path: Column) -> Column:
    """The first three segments of a path on a known host; null elsewhere."""
    segments = F.split(path, "/")
    return F.when(F.get(segments, F.lit(0)).isin(*REPO_HOSTS) & (F.size(segments) >= 3), F.array_join(F.slice(segments, 1, 3), "/"))


def module_refs(path: Column) -> Column:
    """A module path and, where it differs, its owning repository; none for an empty path."""
    p = stripped(path)
    return F.when(p == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(p, owning_repo(p)))))


def version_match(left: Column, right: Column) -> Column:
    return F.when(left == right, F.lit("exact")).when((left == "") | (right == ""), F.lit("unknown")).otherwise(F.lit("mismatch"))


def node_id(kind: Column, ref: Column) -> Column:
    return F.concat(F.lit("n"), F.substring(F.sha1(F.concat(kind, F.lit("\0"), ref)), 1, 12))


def kind_node_id(kind: Column) -> Column:
    return F.concat(F.lit("k"), F.substring(F.sha1(F.concat(F.lit("kind:"), kind)), 1, 8))


def provenance(file: Column, line: Column) -> Column:
    return F.when(line > 0, F.concat_ws(":", file, line.cast("string"))).otherwise(file)
