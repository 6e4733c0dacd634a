"""The training-corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Each stage works on all that its predecessor kept, and what it decides takes effect: documents of no known language go, then
toxic ones, then copies of equal texts, then all but one of each group of near duplicates; what is left is packed. All
stages but the last return the columns of the documents they were given, clashing names too. Nulls in any column, repeated rows
and very long texts are treated as the operators' docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvane.llm import exact_dedup, langid, near_copies, packing, toxicity
from corvane.llm.common import staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9. Documents without a letter, or whose text is null, go; all others stay, whatever their language."""
    return langid.with_language(docs)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. Documents of a score of 0.3 or more go; without labels of both classes none does."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Of texts equal but for white space one row stays, that with the smallest id."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, its links verified and completed. Of documents that a chain of five-word similarities of 0.8 or more connects
    one stays, that with the smallest id."""
    return near_copies.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. A row for each piece of what is left; nothing is dropped."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", non_toxic),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("packing", packed),
]

#: Learned models and tokenizers are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
