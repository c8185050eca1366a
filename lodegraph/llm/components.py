"""Connected components by randomised contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.workspace import Workspace

#: Rows up to which one side of a join is broadcast, some 100 bytes each in the driver.
FEW = 100_000


def side(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of at most `rows` rows, as one side of a join: broadcast if these are few, else merged.

    Spark would go by bytes, and a shuffled table below its threshold may be many times as large in the driver.
    """
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def _gathered(df: DataFrame, rows: int | None) -> DataFrame:
    """`df` in a few partitions if it has few rows, so that a late round doesn't write hundreds of files of a row each."""
    return df.coalesce(8) if rows is not None and rows <= FEW else df


def connected_components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long); component is its least node.

    In each round every node goes over to that node of its closed neighbourhood
    with the least salted hash, which leaves at most three quarters of the nodes
    on average whatever the graph's shape. A hub costs no more than its edges:
    minima are combined before the shuffle. Besides row counts, only tables of few rows reach the driver.
    """
    live = edges.filter("a <> b").select("a", "b")
    labels = links = None
    step = 0
    while True:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        live = work.keep(_gathered(both.distinct(), links), f"{name}-edges{step}")
        if step:
            work.drop(f"{name}-edges{step - 1}", f"{name}-step{step - 1}")
        links = live.count()
        if not links:
            break
        salted = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("h"), F.col(c).alias("to"))
        near = live.groupBy("a").agg(F.min(salted("b")).alias("m"))
        goes = work.keep(_gathered(near.select(F.col("a").alias("at"), F.least(F.col("m"), salted("a"))["to"].alias("to")), links), f"{name}-step{step}")
        if labels is None:
            most = links
            moved = goes.select(F.col("at").alias("node"), F.col("to").alias("now"))
        else:
            moved = labels.join(side(goes, links), labels["now"] == goes["at"], "left").select("node", F.coalesce("to", "now").alias("now"))
        labels = work.keep(_gathered(moved, most), f"{name}-labels{step}")
        if step:
            work.drop(f"{name}-labels{step - 1}")
        left = live.join(side(goes, links), live["a"] == goes["at"]).select(F.col("to").alias("x"), "b")
        right = goes.withColumnsRenamed({"at": "at2", "to": "y"})
        live = left.join(side(right, links), left["b"] == right["at2"]).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a < b")
        step += 1
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("now").agg(F.min("node").alias("component"))
    return labels.join(side(least, most), "now").select("node", "component")
