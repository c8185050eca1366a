"""Cap'n Proto const data: service and image facts from `key = "value"` fields, by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.functions.text import stripped
from lodegraph.operators.parsing import earliest

#: a quoted string, or a comment
_COMMENT = r'^((?:[^"#]|"[^"]*")*+)#.*$'
_FIELD = r'([A-Za-z0-9_]*)[ \t]*=(?:[^="]*"([^"]*)")?'


def fields(lines: DataFrame) -> DataFrame:
    """Each `key =` on each line in order: the columns of `lines` (text last used), key, value (empty unless a string follows), pos.

    Files without a line that begins a const are left out.
    """
    bare = lines.withColumn("bare", F.regexp_replace("text", _COMMENT, "$1"))
    has = bare.filter(stripped("bare").rlike("^const( |$)")).select("root", "file").distinct()
    kept = bare.join(has, ["root", "file"], "left_semi")
    found = F.arrays_zip(F.regexp_extract_all("bare", F.lit(_FIELD), 1).alias("key"), F.regexp_extract_all("bare", F.lit(_FIELD), 2).alias("value"))
    return kept.select("root", "file", "line", F.posexplode(found).alias("pos", "f")).select("root", "file", "line", "pos", F.col("f.key").alias("key"), F.col("f.value").alias("value")).filter("key <> ''")


def pending_names(fields_: DataFrame, by: list[str]) -> DataFrame:
    """The name fields that the next `worker` takes: no other name, worker, service or image lies between. Empty names aren't taken.

    `fields_`: `by`, line, pos, key, value. A running window over each file in field order.
    """
    w = Window.partitionBy(*by).orderBy("line", "pos")
    marks = F.col("key").isin("name", "worker", "service", "image")
    before = F.last(F.when(marks, F.struct("key", "value", "line")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    at = fields_.withColumn("before", before)
    return at.filter("key = 'worker' and before.key = 'name' and before.value <> ''").select(*by, F.col("before.value").alias("value"), F.col("before.line").alias("line"))


def facts(lines: DataFrame) -> DataFrame:
    """Facts of `lines` (root, file, line, text) of .capnp files: one for each identity and file, the earliest."""
    found = fields(lines)
    kind = F.when(F.col("key") == "image", F.lit(schema.IMAGE)).otherwise(F.lit(schema.SERVICE))
    used = found.filter(F.col("key").isin("service", "to", "image")).select(F.lit(schema.CONSUMER).alias("role"), "root", kind.alias("kind"), F.col("value").alias("ref"), "file", "line")
    made = pending_names(found, ["root", "file"]).select(F.lit(schema.PRODUCER).alias("role"), "root", F.lit(schema.SERVICE).alias("kind"), F.col("value").alias("ref"), "file", "line")
    return earliest(used.unionByName(made))
