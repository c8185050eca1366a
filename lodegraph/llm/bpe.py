"""BPE ids and decoded text of whole documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.word_bpe import WordBPE


def _each(tokenizer_path: str, batch_rows: int, make):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBPE(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                yield make(part, bpe.encode_decode(part.column(1).to_pylist()))

    return each


def encode_decode(docs: DataFrame, tokenizer_path: str, batch_rows: int = 256) -> DataFrame:
    """(doc_id, ids, decoded) for each row of `docs` (doc_id, text): token ids and the text they decode to.

    Null text counts as empty: no ids, and the empty string. Rows may repeat; each has its result, and a null doc_id
    stays null. Texts of any length are encoded whole, one at a time. Other columns are not looked at. An empty table gives no rows.
    """

    def make(part: pa.RecordBatch, done: list[tuple[str, str]]) -> pa.RecordBatch:
        ids = pa.array([list(map(int, a.split())) for a, _ in done], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([b for _, b in done], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_each(tokenizer_path, batch_rows, make), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str, batch_rows: int = 256) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same rows by the same rules, without moving ids and texts out of the task.

    ids_sha256 is over the decimal ids joined by one blank, decoded_sha256 over the decoded text; of a null or empty text both are that of nothing.
    """

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode()).hexdigest()

    def make(part: pa.RecordBatch, done: list[tuple[str, str]]) -> pa.RecordBatch:
        columns = [part.column(0), pa.array([a.count(" ") + 1 if a else 0 for a, _ in done], pa.int64()), pa.array([sha(a) for a, _ in done]), pa.array([sha(b) for _, b in done])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_each(tokenizer_path, batch_rows, make), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
