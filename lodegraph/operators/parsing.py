"""Helpers of extractors whose files are read whole, one after another, inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import stripped

#: The role of a row that reports a file which can't be read; its error stands in `ref`.
FAILED = "failed"


def per_file(files: DataFrame, parse: Callable[[str], list[tuple]], fields: str, path: str = "rel") -> DataFrame:
    """(root, file, `fields`, error) of `files`: a row for each tuple that `parse` makes of a file's text.

    A file that `parse` raises on gives one row with its error and nulls. `path` is the column that names the file.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for root, file, content in frame.itertuples(index=False):
                try:
                    rows += [(root, file, *r, None) for r in parse(bytes(content).decode("utf-8", "replace"))]
                except Exception as e:  # whatever a reader refuses is reported as a row
                    rows.append((root, file, *[None] * len(names), f"{file}: {e}"))
            yield pd.DataFrame(rows, columns=["root", "file", *names, "error"])

    return files.select("root", path, "content").mapInPandas(each, f"root string, file string, {fields}, error string")


def failures(rows: DataFrame, what: str) -> DataFrame:
    """(role, root, kind, ref, file, line): each error among `rows` (root, file, error) as a fact."""
    return rows.filter("error is not null").select(F.lit(FAILED).alias("role"), "root", F.lit("").alias("kind"), F.concat(F.lit(f"{what}: "), "error").alias("ref"), "file", F.lit(0).alias("line"))


def fact(role: str | Column, kind: str | Column, ref: Column | str) -> list[Column]:
    """The columns of a fact, for a row that has root, file and line."""
    own = lambda c: c if isinstance(c, Column) else F.lit(c)
    return [own(role).alias("role"), F.col("root"), own(kind).alias("kind"), (F.col(ref) if isinstance(ref, str) else ref).alias("ref"), F.col("file"), F.col("line")]


def earliest(facts: DataFrame) -> DataFrame:
    """One fact for each identity and file, the earliest; references trimmed, empty ones dropped."""
    return facts.withColumn("ref", stripped("ref")).filter("ref <> ''").groupBy("role", "root", "kind", "ref", "file").agg(F.min("line").alias("line"))
