"""Token ids in compressed bit planes.

A file set is a Parquet table of blocks. Ids are written in ascending doc_id order
and cut into blocks of `block_ids` ids whatever the documents' ends, so that every
block but a shard's last has one size. A block's ids are transposed into planes,
either one a bit (ids of neighbouring magnitude leave high planes all zero) or one a
byte, each compressed with zstandard on its own. A row also holds the block's place in the
chunk index (shard, block, first id, ids) and, run-length coded, which documents
its ids belong to. A shard is one range of doc_id; `index` lists each shard's blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm.byte_tokens import ByteTokens
from lodegraph.llm.slices import sliced

#: Shards whose offsets are broadcast, some 20 bytes each.
FEW_SHARDS = 1_000_000
BLOCK_SCHEMA = "shard int, block long, first_id long, n_ids long, bits boolean, planes array<binary>, doc_seq array<long>, doc_id array<long>, doc_ids_here array<long>"


@dataclass(frozen=True)
class TokenFiles:
    """Parameters: ids in a block, bit or byte planes, zstandard's level, the end-of-document id, stored bytes a shard."""

    block_ids: int = 1 << 16
    bits: bool = False
    level: int = 1
    end_id: int = 0
    shard_bytes: int = 1 << 27
    batch_bytes: int = 1 << 20


def pack(ids: np.ndarray, bits: bool, level: int = 1) -> list[bytes]:
    """Planes of uint32 ids, least significant first, each compressed; all-zero planes at the top are left out."""
    compress = zstandard.ZstdCompressor(level=level).compress
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if not bits:
        return [compress(np.ascontiguousarray(octets[:, k]).tobytes()) for k in range((top.bit_length() + 7) // 8)]
    planes = []
    for k in range(top.bit_length()):
        planes.append(compress(np.packbits((octets[:, k // 8] >> (k % 8)) & 1, bitorder="little").tobytes()))
    return planes


def unpack(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The uint32 ids that `pack` was given."""
    expand = zstandard.ZstdDecompressor().decompress
    octets = np.zeros((n, 4), dtype=np.uint8)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(expand(plane, max_output_size=n + 64), dtype=np.uint8)
        if bits:
            octets[:, k // 8] |= np.unpackbits(raw, count=n, bitorder="little") << (k % 8)
        else:
            octets[:, k] = raw
    return octets.view("<u4").reshape(-1)


def _combine_table() -> np.ndarray:
    """crc32 of zero bytes as a linear map: [j] advances a crc by 2**j zero bytes, a bit a column."""
    rows = np.zeros((64, 32), dtype=np.uint64)
    for i in range(32):
        crc = 1 << i
        for _ in range(8):
            crc = (crc >> 1) ^ (0xEDB88320 if crc & 1 else 0)
        rows[0, i] = crc
    for j in range(1, 64):
        for i in range(32):
            rows[j, i] = _apply(rows[j - 1], int(rows[j - 1, i]))
    return rows


def _apply(columns: np.ndarray, crc: int) -> int:
    picked = columns[[i for i in range(32) if crc >> i & 1]]
    return int(np.bitwise_xor.reduce(picked)) if len(picked) else 0


_ADVANCE = _combine_table()


def crc32_join(left: int, right: int, right_bytes: int) -> int:
    """The crc32 of two byte strings put together, from each one's."""
    j = 0
    while right_bytes >> j:
        if right_bytes >> j & 1:
            left = _apply(_ADVANCE[j], left)
        j += 1
    return left ^ right


class _Blocks:
    """Cuts one shard's stream of documents into blocks."""

    def __init__(self, p: TokenFiles, shard: int):
        self.p, self.shard, self.block, self.first = p, shard, 0, 0
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.docs: list[tuple[int, int | None, int]] = []

    def add(self, seq: int, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.p.block_ids - self.held]
            at += len(part)
            self.parts.append(part)
            self.held += len(part)
            self.docs.append((seq, doc_id, len(part)))
            if self.held == self.p.block_ids:
                yield self.cut()

    def cut(self) -> tuple:
        ids = np.concatenate(self.parts)
        row = (self.shard, self.block, self.first, self.held, self.p.bits, pack(ids, self.p.bits, self.p.level), *map(list, zip(*self.docs, strict=True)))
        self.block, self.first = self.block + 1, self.first + self.held
        self.parts, self.docs, self.held = [], [], 0
        return row


_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.bool_()), ("planes", pa.list_(pa.binary())), ("doc_seq", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("doc_ids_here", pa.list_(pa.int64()))]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def encode_blocks(docs: DataFrame, tokenizer_path: str, p: TokenFiles, shards: int) -> DataFrame:
    """Blocks (BLOCK_SCHEMA) of every row of `docs` (doc_id, text) in ascending doc_id order, null ids first.

    Null text counts as empty, so its document is the end id alone. An empty table gives no blocks. Rows with one doc_id
    are ordered by text. Shards are ranges of doc_id and, within one doc_id, of how the text begins, and short texts
    that are alike are dealt to several, so that many rows without doc_id don't meet in one shard; other columns are not looked at. What follows a document's end id
    is the next document's first id, also from one block to the next.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteTokens(tokenizer_path)
        blocks, seq = _Blocks(p, TaskContext.get().partitionId()), 0
        end = np.array([p.end_id], dtype=np.uint32)
        for batch in batches:
            for part in sliced(batch, 1, p.batch_bytes):
                out = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    out += blocks.add(seq, doc_id, np.concatenate([ids, end]))
                    seq += 1
                if out:
                    yield _batch(out)
        if blocks.held:
            yield _batch([blocks.cut()])

    typed = docs.select(F.col("doc_id").cast("long"), "text").withColumn("salt", spread_equal())
    ordered = typed.repartitionByRange(shards, "doc_id", F.substring("text", 1, 32), "salt").sortWithinPartitions("doc_id", "text")
    return ordered.select("doc_id", "text").mapInArrow(each, BLOCK_SCHEMA)


def spread_equal() -> Column:
    """A number that parts rows of one short text, or none, which are alike under one doc_id, so that ranges can split them; 0 for other rows."""
    return F.when(F.length(F.coalesce("text", F.lit(""))) <= 32, F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))


def stored_bytes(docs: DataFrame) -> int:
    """How much `docs` reads, as its files' sizes say; text bytes, counted, where it doesn't read files."""
    planned = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return planned if planned < 1 << 60 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def write(docs: DataFrame, path: str, tokenizer_path: str, params: TokenFiles | None = None, shards: int | None = None) -> None:
    """Writes `docs` as token files: `path`/blocks, and the chunk index in `path`/index.

    There are as many shards as the stored bytes need, and at least as many as a shuffle has partitions.

    The index has, for each block, the ids of all documents before it (`start`), and where
    in which shard it lies. It is made from the blocks' place columns alone.
    """
    spark = docs.sparkSession
    p = params or TokenFiles()
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(docs) // p.shard_bytes))
    encode_blocks(docs, tokenizer_path, p, shards).write.mode("overwrite").parquet(f"{path}/blocks")
    places = spark.read.parquet(f"{path}/blocks").select("shard", "block", "first_id", "n_ids")
    # one row a shard
    totals = places.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = totals.select(F.col("shard").alias("s"), (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    index = places.join(F.broadcast(before), F.col("shard") == F.col("s")).select("shard", "block", (F.col("before") + F.col("first_id")).alias("start"), "n_ids")
    index.write.mode("overwrite").parquet(f"{path}/index")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = {name: batch.column(name)[row].as_py() for name in ("shard", "block", "start", "n_ids", "bits", "planes", "doc_seq", "doc_id", "doc_ids_here")}
            raw = unpack(one["planes"], one["n_ids"], one["bits"]).tobytes()
            lengths = np.array(one["doc_ids_here"], dtype=np.int64)
            ends = np.cumsum(lengths)
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array([one["shard"]] * n, pa.int32()), pa.array(one["doc_seq"], pa.int64()), pa.array([one["block"]] * n, pa.int64()), pa.array(one["doc_id"], pa.int64()), pa.array(one["start"] + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                names=["shard", "seq", "block", "doc_id", "start", "n", "crc"],
            )


def _join_crcs(crcs, lengths):
    out = []
    for some, sizes in zip(crcs, lengths, strict=True):
        crc = int(some[0])
        for right, n in zip(some[1:], sizes[1:], strict=True):
            crc = crc32_join(crc, int(right), 4 * int(n))
        out.append(crc)
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each written document, from the files alone.

    start counts the ids of all documents before it. A document that several blocks
    share has one row a block until its pieces' checksums are joined, so no task holds
    its ids at once.
    """

    @F.pandas_udf("long")
    def join_crcs(crcs: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series(_join_crcs(crcs, lengths), dtype="int64")

    # where each shard begins: a row a shard, so that blocks, with their planes, stay where they are read
    begins = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.min("start").alias("begins"))
    blocks = spark.read.parquet(f"{path}/blocks")
    if begins.count() <= FEW_SHARDS:
        begins = F.broadcast(begins)
    blocks = blocks.join(begins, "shard").withColumn("start", F.col("begins") + F.col("first_id"))
    columns = ("shard", "block", "start", "n_ids", "bits", "planes", "doc_seq", "doc_id", "doc_ids_here")
    pieces = blocks.select(*columns).mapInArrow(_pieces, "shard int, seq long, block long, doc_id long, start long, n long, crc long")
    piece = F.struct("block", "n", "crc")
    docs = pieces.groupBy("shard", "seq").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    joined = F.when(F.size("pieces") == 1, F.col("pieces")[0]["crc"]).otherwise(join_crcs(F.col("pieces.crc"), F.col("pieces.n")))
    return docs.select("doc_id", "start", "n_tokens", joined.alias("ids_crc32"))
