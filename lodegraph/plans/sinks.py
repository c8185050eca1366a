"""Text reports as sections in order, written by executors.

A section is a literal or rows, each rendered to its lines in a column `text`, in the order of some
columns. Writing sorts a section by ranges of its order and gives one file a range, so that no task and not the
driver has all of it: `path`/0000, `path`/0001 and so on hold the sections, and their part files in name order
are the report.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodegraph.plans.lineage import cut


@dataclass
class Rows:
    """Rows (text, ...) in the order of the columns `order`. A text has no line end of its own at its end."""

    df: DataFrame
    order: tuple[str, ...]

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.order).select("text")


@dataclass
class Report:
    """Sections in order; a literal has no line end of its own at its end, and an empty one stands for nothing."""

    spark: SparkSession
    sections: list[str | Rows] = field(default_factory=list)

    def add(self, *sections: str | Rows) -> Report:
        self.sections += [s for s in sections if s != ""]
        return self

    def lines(self) -> Iterator[str]:
        """The report for a stream at the driver, such as a terminal: a row at a time."""
        for section in self.sections:
            if isinstance(section, str):
                yield section + "\n"
            else:
                for row in section.sorted().toLocalIterator():
                    yield row["text"] + "\n"

    def text(self) -> str:
        return "".join(self.lines())

    def write(self, path: str) -> None:
        """Files of text below `path`; executors write them, the driver sends only literals."""
        for k, section in enumerate(self.sections):
            rows = self.spark.createDataFrame([(section,)], "text string").coalesce(1) if isinstance(section, str) else section.sorted()
            rows.write.mode("overwrite").text(f"{path.rstrip('/')}/{k:04d}")


def quoted(text: str) -> str:
    """In double quotes, with control characters, quotes and backslashes escaped."""
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r", "\a": "\\a", "\b": "\\b", "\f": "\\f", "\v": "\\v"}
    return '"' + "".join(short.get(c) or (c if c.isprintable() else f"\\x{ord(c):02x}" if ord(c) < 128 else f"\\u{ord(c):04x}" if ord(c) < 1 << 16 else f"\\U{ord(c):08x}") for c in text) + '"'


def json_text(value: object, indent: int = 0) -> str:
    """JSON by two blanks of indent, from `indent` blanks on, with <, > and & escaped."""
    out = json.dumps(value, indent=2, ensure_ascii=False)
    for c in "<>&  ":
        out = out.replace(c, f"\\u{ord(c):04x}")
    return out.replace("\n", "\n" + " " * indent)


@F.pandas_udf(StringType())
def quoted_column(text: pd.Series) -> pd.Series:
    return text.map(quoted, na_action="ignore")


@F.pandas_udf(StringType())
def json_column(text: pd.Series) -> pd.Series:
    return text.map(json_text)


def json_object(fields: dict[str, Column | dict], indent: int) -> Column:
    """A JSON object's text, of columns that are JSON already or of further objects."""
    parts: list[Column] = [F.lit("{")]
    for k, (name, value) in enumerate(fields.items()):
        parts.append(F.lit(("," if k else "") + "\n" + " " * (indent + 2) + json.dumps(name) + ": "))
        parts.append(json_object(value, indent + 2) if isinstance(value, dict) else value)
    return F.concat(*parts, F.lit("\n" + " " * indent + "}"))


def json_items(rows: Rows) -> list[str | Rows]:
    """Sections of an array's items, with a comma after each but the last; none of an empty array.

    Rows that come last in the order are alike, so the array's end is told from their number.
    """
    df, order = cut(rows.df), rows.order
    last = df.agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    if last is None:
        return []
    is_last = F.lit(True)
    for c in order:
        is_last = is_last & F.col(c).eqNullSafe(F.lit(last[c]))
    ends = df.filter(is_last).agg(F.count("*").alias("n"), F.first("text").alias("text")).first()
    comma = F.when(F.col("id") < ends["n"] - 1, ",").otherwise("")
    tail = df.sparkSession.range(ends["n"]).select("id", F.concat(F.lit(ends["text"]), comma).alias("text"))
    return [Rows(df.filter(~is_last).withColumn("text", F.concat("text", F.lit(","))), order), Rows(tail, ("id",))]
