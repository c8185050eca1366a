"""Chat formatting of maximal conversations: cumulative snapshots collapse into the longest.

Logs often hold a conversation once per turn, each time with all turns so far. A
rolling hash of every turn prefix shows which conversations are prefixes of longer
ones; an anti-join drops those, and equal conversations keep their least conv_id.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm.workspace import Workspace


def _content(seed: int) -> Column:
    """A hash of role and text that tells null from empty."""
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def segment(role: Column, text: Column) -> Column:
    """One rendered turn. Null role and text are empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def dealt_turns(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """conv_id, role and text of `turns`, dealt out by ranges of their order, with part (the range's number), seq (the place in that order), and the hashes and size of the content.

    Turns are ordered by turn, role and text, null first. A long conversation, or the many rows without conv_id, are
    spread over ranges, which follow each other as their turns do. `parts` is how many ranges; None leaves that to Spark.
    """
    order = ["conv_id", "turn", "role", F.substring("text", 1, 32)]
    own = turns.select("conv_id", "turn", "role", "text")
    dealt = own.repartitionByRange(*order) if parts is None else own.repartitionByRange(parts, *order)
    size = F.length(segment(F.col("role"), F.col("text"))).cast("long")
    placed = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"))
    return placed.withColumns({"h1": _content(1), "h2": _content(2), "size": size})


def _before(of: DataFrame, **sums: Column) -> DataFrame:
    """(c, p, and `sums` over the earlier parts of a conversation): a row for each conversation and part."""
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return of.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), *(F.coalesce(s.over(w), F.lit(0).cast("long")).alias(name) for name, s in sums.items()))


def _with(turns: DataFrame, earlier: DataFrame) -> DataFrame:
    return turns.join(earlier, turns["conv_id"].eqNullSafe(earlier["c"]) & (turns["part"] == earlier["p"])).drop("c", "p")


def numbered_turns(dealt: DataFrame) -> DataFrame:
    """conv_id, part, seq, turn_no, the hashes (x1, x2) of place and content, start, and p1 and p2 within the part. Texts stay behind."""
    narrow = dealt.select("conv_id", "part", "seq", "h1", "h2", "size")
    w = Window.partitionBy("conv_id", "part").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = narrow.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    earlier = _before(sizes, n_before=F.sum("n"), chars_before=F.sum("chars"))
    placed = _with(narrow, earlier).withColumn("turn_no", (F.col("n_before") + F.row_number().over(w)).cast("long"))
    hashed = placed.withColumns({"x1": F.expr("xxhash64(1L, turn_no, h1, h2)"), "x2": F.expr("xxhash64(2L, turn_no, h2, h1)")})
    return hashed.select(
        "conv_id",
        "part",
        "seq",
        "turn_no",
        "x1",
        "x2",
        (F.col("chars_before") + F.sum("size").over(upto) - F.col("size")).alias("start"),
        F.expr("bit_xor(x1)").over(upto).alias("p1"),
        F.expr("bit_xor(x2)").over(upto).alias("p2"),
    )


def prefix_hashes(numbered: DataFrame) -> DataFrame:
    """conv_id, seq, turn_no, start, the rolling hash (p1, p2) of the turns up to each, and whether it is the last.

    The rolling hash is the exclusive or of hashes of (place, role, text), 128 bits in all; that of a part's turns
    is joined with what its conversation's earlier parts come to.
    """
    ends = numbered.groupBy("conv_id", "part").agg(F.expr("bit_xor(x1)").alias("e1"), F.expr("bit_xor(x2)").alias("e2"), F.max("turn_no").alias("top"))
    whole = ends.groupBy(F.col("conv_id").alias("whole")).agg(F.max("top").alias("n_turns"))
    earlier = _before(ends, e1=F.expr("bit_xor(e1)"), e2=F.expr("bit_xor(e2)"))
    lasts = earlier.join(whole, earlier["c"].eqNullSafe(whole["whole"])).drop("whole")
    both = lambda a, b: F.col(a).bitwiseXOR(F.col(b)).alias(a)
    return _with(numbered, lasts).select("conv_id", "seq", "turn_no", "start", both("p1", "e1"), both("p2", "e2"), (F.col("turn_no") == F.col("n_turns")).alias("last"))


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of conversations that no longer one begins with, one for each content."""
    whole = hashed.filter("last").groupBy(F.col("turn_no").alias("n_turns"), "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    longer = hashed.filter("not last").select(F.col("turn_no").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(longer, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns", "copies")


def format_chats(spark: SparkSession, conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """Rendered turns of maximal conversations: conv_id, turn_no (from 1), role, segment, start, n_turns, copies.

    The segments of a conversation in turn order are its rendered text; `start` is where
    each begins, so that no task need hold a whole conversation. `copies` counts
    the equal conversations that this one stands for. Rows with null conv_id are one
    conversation; no task holds a whole conversation, as turns are dealt out by ranges (`parts` of them). Other columns are not looked at. An empty table gives no rows.
    """
    work = Workspace(spark, "chat")
    dealt = work.keep(dealt_turns(conversations, parts), "dealt")
    hashed = work.keep(prefix_hashes(work.keep(numbered_turns(dealt), "numbered")), "turns")
    work.drop("numbered")
    kept = maximal_conversations(hashed).withColumnRenamed("conv_id", "id")
    chosen = hashed.join(kept, hashed["conv_id"].eqNullSafe(kept["id"])).select("seq", "turn_no", "start", "n_turns", "copies")
    # rendered at the end, for conversations that stay
    told = dealt.select("conv_id", "seq", "role", segment(F.col("role"), F.col("text")).alias("segment"))
    return told.join(chosen, "seq").select("conv_id", "turn_no", "role", "segment", "start", "n_turns", "copies")


ORACLE = """
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turn_no,
         count(*) OVER (PARTITION BY conv_id) AS n_turns,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS segment
  FROM conversations),
prefixes AS (
  SELECT *, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING) AS upto,
         sum(length(segment)) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING) - length(segment) AS start
  FROM placed),
whole AS (SELECT upto, min(conv_id) AS conv_id, count(*) AS copies FROM prefixes WHERE turn_no = n_turns GROUP BY upto),
kept AS (SELECT w.* FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.turn_no < p.n_turns AND p.upto = w.upto))
SELECT p.conv_id, p.turn_no, p.role, p.segment, CAST(p.start AS BIGINT) AS start, p.n_turns, k.copies
FROM prefixes p JOIN kept k ON p.conv_id IS NOT DISTINCT FROM k.conv_id
"""
