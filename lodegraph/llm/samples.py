"""Bounded samples of labelled rows, and exact selection of a k-th largest value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """(doc_id, label) of at most `per_class` rows for each of the labels 0 and 1, by least hash of doc_id.

    Rows without doc_id or label don't count; of several rows with one doc_id one is taken.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    taken = [rows.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    return taken[0].unionByName(taken[1])


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 1000) -> float | None:
    """The exact k-th largest non-null value of a double column, by narrowing histograms; None where there are fewer.

    Each round sends at most `bins` counts to the driver, and the last at most `few` values.
    """
    values = df.select(F.col(column).alias("v")).filter("v is not null")
    n, lo, hi = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if k < 1 or n < k:
        return None
    while lo < hi and n > few:
        width = (hi - lo) / bins
        if lo + width == lo:
            break
        at = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        inside = values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        counted = inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for row in sorted(counted, key=lambda r: -r["at"]):
            if k <= row["n"]:
                n, lo, hi = row["n"], row["lo"], row["hi"]
                break
            k -= row["n"]
    if lo == hi:
        return lo
    inside = values.filter((F.col("v") >= lo) & (F.col("v") <= hi))
    if n <= few:
        return sorted((r["v"] for r in inside.collect()), reverse=True)[k - 1]
    for row in inside.groupBy("v").count().orderBy(F.col("v").desc()).toLocalIterator():
        if k <= row["count"]:
            return row["v"]
        k -= row["count"]
    return None
