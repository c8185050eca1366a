"""Source trees as DataFrames of files and of lines."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.sources import tree
from lodegraph.sources.pruning import FILES, HIDDEN, READS, SKIPS, Pruning

MAP, VERIFY = tuple(e for e in READS if e != "docs"), ("gocode", "docs")


def scan_shared(spark: SparkSession, roots: list[str], extractors: tuple[str, ...] = tuple(READS)) -> DataFrame:
    """FILES below folders that the executors can read, walked and read by their tasks: see `tree`.

    `path` is the root as given, a slash and the path below it. Only files that one of `extractors` reads are there.
    """
    return tree.read(spark, roots, extractors) if roots else spark.createDataFrame([], FILES)


def walk(root: str, extractors: tuple[str, ...] = tuple(READS)) -> Iterator[str]:
    """Paths below `root`, in order, of files that one of `extractors` reads. Folders that all of them leave out aren't entered."""
    pruning, place = Pruning(extractors), tree.Storage(root)
    todo = [("", live)] if place.exists() and (live := pruning.start(root)) else []
    while todo:
        rel, live = todo.pop()
        folders, names = place.entries(rel)
        depth = rel.count("/") + 1 if rel else 0
        for name in names:
            if pruning.reads(live, name, depth):
                yield os.path.join(root, rel, name)
        below = [(os.path.join(rel, f), pruning.below(live, f, depth)) for f in folders]
        todo += [b for b in reversed(below) if b[1]]


def scan_local(spark: SparkSession, roots: list[str], extractors: tuple[str, ...] = tuple(READS)) -> DataFrame:
    """FILES below folders that only the driver can read, such as a checkout: listed and read here and sent out.

    Only files that one of `extractors` reads are opened. Links to folders aren't followed. Trees larger than
    the driver belong on shared storage: `scan_shared`.
    """
    rows = []
    for k, root in enumerate(roots):
        for path in walk(root, extractors):
            rel = os.path.relpath(path, root)
            with open(path, "rb") as f:
                rows.append((root, k, rel if root == "." else os.path.join(root, rel), rel, os.path.basename(path), f.read()))
    return spark.createDataFrame(rows, FILES)


def _skipped(extractor: str) -> Column:
    """Whether a file lies in a folder that `extractor` leaves out."""
    names, root_too = SKIPS[extractor]
    folders = F.slice(F.split("rel", "/"), 1, F.greatest(F.lit(0), F.size(F.split("rel", "/")) - 1))
    skipped = F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    hidden = extractor in HIDDEN
    if hidden:
        skipped = skipped | F.exists(folders, lambda d: d.startswith("."))
    if root_too:
        base = F.element_at(F.split(F.regexp_replace("root", "/+$", ""), "/"), -1)
        skipped = skipped | base.isin(*names) | (base.startswith(".") & (base != ".") if hidden else F.lit(False))
    return skipped


def kept_by(files: DataFrame, extractor: str) -> DataFrame:
    """Without files in the folders that `extractor` leaves out."""
    return files.filter(~_skipped(extractor))


def lines(files: DataFrame, file: str = "path") -> DataFrame:
    """(root, file, line, text): lines from 1, without their ends. `file` says which column names the file."""
    whole = F.decode("content", "UTF-8")
    each = files.select("root", F.col(file).alias("file"), F.posexplode(F.split(whole, "\r?\n")).alias("at", "text"))
    return each.select("root", "file", (F.col("at") + 1).alias("line"), "text")
