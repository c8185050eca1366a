"""A corpus from raw documents to token digests, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets; between
stages documents are written as Parquet and read again. All but the last return
the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import bpe, importance, mixing, pii
from lodegraph.llm.near_dedup import NearDedup, near_components
from lodegraph.llm.workspace import Workspace


#: Token shares by language; what low text is left has no share to meet.
LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15, "low": None}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps.

    Null and empty texts weigh 0 and stay or go as such; rows that repeat stay or go together, and those without doc_id are
    drawn by their text. An empty table gives no rows.
    """
    return importance.keep_good(spark, docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more, the least doc_id.

    Rows that share a doc_id are one document and leave one row, that of the least text, then of the
    least other columns. Rows without doc_id, and documents without words, stay. An empty table gives no rows.
    """
    found = near_components(spark, docs, NearDedup(words=5, percent=80, matches=14))
    kept = found.filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept")).distinct()
    # a row's own columns stay in a struct, so that no name can clash
    rows = docs.select(F.col("doc_id").alias("key"), F.struct("*").alias("row"))
    first = rows.filter("key is not null").join(kept.hint("merge"), F.col("key") == F.col("kept"), "left_semi").groupBy("key").agg(F.min_by("row", F.struct(F.col("row.text"), F.xxhash64("row"))).alias("row"))
    return first.select("row.*").unionByName(docs.filter("doc_id is null"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with spans of personal data replaced by their kinds. Null texts stay null, repeated rows stay, an empty table gives no rows."""
    return pii.redact_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say; none that is mainly of a wanted domain is left out.

    Null and empty texts have the rate of the classifier's constant; repeated rows and rows without doc_id are copied alike. An
    empty table gives no rows.
    """
    return mixing.mixed_documents(spark, docs, _labels(spark, sf_dir), mixing.Mixing(targets=LANGUAGES, least=1.0, spare=0.02))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; null texts count as empty, a null doc_id stays null, an empty table gives no rows."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("personal data", private_data),
    ("mixing", mixture),
    ("tokens", tokens),
]

#: Model fitting and signature joins have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.keep(docs, f"stage{k}")
            if k:
                work.drop(f"stage{k - 1}")
    return docs
