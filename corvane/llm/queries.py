"""The queries of the training-data operators and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvane.llm import alignment, bpe, exact_dedup, langid, line_rules, media, packing, resampling, sharding, simhash, token_counts, toxicity, warc
from corvane.llm.common import table


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_sharding": sharding.op3,
        "op4_simhash": simhash.op4,
        "op5_media_columns": media.op5,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_warc": warc.op7,
        "op8_token_counts": op8_token_counts,
        "op9_language_id": op9_language_id,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_line_frequency": line_rules.op11,
        "op12_importance_resampling": resampling.op12,
        "op13_tokenizer_alignment": alignment.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY t)""",
        "op11_line_frequency": line_rules.OP11_SQL,
        "op12_importance_resampling": resampling.OP12_SQL,
    }
