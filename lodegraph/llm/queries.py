"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodegraph.llm import bpe, chat, fingerprints, importance, mixing, periodic_runs, pii, quality_rules, token_files, token_transducer, toxicity, vector_codes
from lodegraph.llm.near_dedup import NearDedup, near_components
from lodegraph.llm.workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "tokens").path
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(spark, path)


def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


def fingerprint_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_components(spark, table(spark, sf_dir, "documents"))


def op3_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_certified_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_maximal_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark, table(spark, sf_dir, "conversations"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(spark, table(spark, sf_dir, "documents"), NearDedup(words=3, percent=85, matches=16))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.looped(table(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark, table(spark, sf_dir, "embeddings"))


def op13_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_bit_plane_tokens,
            op2_minhash_fingerprints,
            op3_speculative_bpe,
            op4_pii_spans,
            op5_importance_resampling,
            op6_ordinal_toxicity,
            op7_certified_quality_rules,
            op8_soft_mixing,
            op9_maximal_chats,
            op10_minhash_near_dedup,
            op11_periodic_runs,
            op12_vector_codes,
            op13_transducer_token_counts,
            fingerprint_components,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_certified_quality_rules": quality_rules.oracle(), "op9_maximal_chats": chat.ORACLE, "op12_vector_codes": vector_codes.oracle()}
