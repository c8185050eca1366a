"""Definitions and references of a symbol database, placed by joins."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing, suppress
from urllib.parse import quote

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.plans.lineage import shared_folder

#: What is read, by the names of tables and views and their columns, the first that is there; older files lack the views.
TABLES = {
    "defs": ((("v_defs", "token, node_id"), ("node_defs", "token, node_id")), "token string, node_id string"),
    "refs": ((("v_refs", "token, referrer_node_id"), ("node_refs", "token, node_id")), "token string, node_id string"),
    "nodes": ((("nodes", "id, source_file"),), "id string, source_file string"),
    "ast": ((("_ast", "node_id, start_row"),), "node_id string, start_row int"),
}
BATCH = 20_000
#: Row numbers that one task reads.
RANGE = 500_000


def _open(name: str) -> sqlite3.Connection:
    """The database file of that name, which Spark brings to each executor once; it is read from disk, page by page."""
    return sqlite3.connect(f"file:{quote(SparkFiles.get(name))}?mode=ro&immutable=1", uri=True)


def _brought(spark: SparkSession, path: str) -> str:
    """Has executors fetch the file at `path`, from any file system that Spark reads; its name among their files."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, name = hadoop.Path(path), f"symbols-{uuid.uuid4().hex}.db"
    conf = spark._jsc.hadoopConfiguration()
    target = hadoop.Path(f"{shared_folder(spark)}/{name}")
    hadoop.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    spark.sparkContext.addFile(target.toString())
    return name


def _ranges(spark: SparkSession, name: str, size: int) -> list[tuple[str, str, int | None]]:
    """(table, query, first row number) of what tasks read: ranges of row numbers, and views and tables without those whole."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with closing(_open(name)) as db:
                there = dict(db.execute("select name, type from sqlite_master where type in ('table', 'view')").fetchall())
                found = []
                for table, (forms, _) in TABLES.items():
                    source, columns = next(((t, c) for t, c in forms if t in there), forms[-1])
                    low = high = None
                    if there.get(source) == "table":
                        # without row numbers the table is read whole
                        with suppress(sqlite3.OperationalError):
                            low, high = db.execute(f"select min(rowid), max(rowid) from {source}").fetchone()
                            low, high = (0, -1) if low is None else (low, high)
                    found.append((table, f"select {columns} from {source}", low, high))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["name", "query", "low", "high"])

    told = spark.range(1, numPartitions=1).mapInArrow(look, "name string, query string, low long, high long").collect()
    return [(r["name"], r["query"], first) for r in told for first in ([None] if r["low"] is None else range(r["low"], r["high"] + 1, size))]


def read(spark: SparkSession, path: str, size: int = RANGE) -> dict[str, DataFrame]:
    """defs, refs, nodes and ast of the SQLite file at `path`, on any file system that Spark reads.

    Each executor fetches the file once to its disk, and tasks read ranges of row numbers from there, in
    batches; views are one task each. Nothing goes through the driver, and no worker holds the file.
    """
    name = _brought(spark, path)
    parts = _ranges(spark, name, size)

    def table(which: str, fields: str) -> DataFrame:
        own = [(query, first) for t, query, first in parts if t == which]
        schema = pa.schema([(f.split()[0], pa.int32() if f.endswith(" int") else pa.string()) for f in fields.split(", ")])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    query, first = own[k]
                    with closing(_open(name)) as db:
                        rows = db.execute(query) if first is None else db.execute(f"{query} where rowid >= ? and rowid < ?", (first, first + size))
                        while some := rows.fetchmany(BATCH):
                            yield pa.RecordBatch.from_arrays([pa.array([_typed(x, t) for x in c], t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

        return spark.range(0, len(own), 1, max(1, len(own))).mapInArrow(each, fields)

    return {which: table(which, fields) for which, (_, fields) in TABLES.items()}


def _typed(value: object, kind: pa.DataType) -> object:
    """SQLite's columns hold values of any type."""
    if value is None:
        return None
    return int(value) if kind == pa.int32() else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def missing(spark: SparkSession, path: str) -> str | None:
    """Why the database at `path` can't be read; None if it can."""
    if not path:
        return "symbol database: no path configured"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return None if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else f"symbol database: not readable at {path}"


def provenance(tokens: DataFrame, nodes: DataFrame, ast: DataFrame) -> DataFrame:
    """(token, node_id, file, line): `tokens` (token, node_id) at their nodes' files; line 0 where no syntax row is known.

    `nodes`: id, source_file; `ast`: node_id, start_row (from 0).
    """
    placed = tokens.join(nodes.select(F.col("id").alias("node"), "source_file"), F.col("node_id") == F.col("node"))
    rows = ast.select(F.col("node_id").alias("at"), "start_row")
    return placed.join(rows, F.col("node_id") == F.col("at"), "left").select("token", "node_id", F.coalesce("source_file", F.lit("")).alias("file"), F.coalesce(F.col("start_row") + 1, F.lit(0)).cast("int").alias("line"))


def facts(defs: DataFrame, refs: DataFrame, nodes: DataFrame, ast: DataFrame, root: str) -> DataFrame:
    """Producers from `defs` and consumers from `refs` (token, node_id); empty tokens are dropped."""
    one = lambda df, role, kind: provenance(df, nodes, ast).filter("token <> ''").select(F.lit(role).alias("role"), F.lit("gocode").alias("extractor"), F.lit(root).alias("root"), F.lit(kind).alias("kind"), F.col("token").alias("ref"), "file", "line")
    return one(defs, schema.PRODUCER, schema.GO_SYMBOL).unionByName(one(refs, schema.CONSUMER, schema.GO_SYMBOL))
