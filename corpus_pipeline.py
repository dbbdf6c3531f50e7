"""The corpus pipeline: stages that each call one operator, every result written and reread as the next one's docs.

Texts of any length are taken whole, an empty table gives an empty result, and other columns may have any name; all
stages but the last return the columns they got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import decontaminate, jaccard, packing, quality, secrets
from lodeframe.llm.queries import table, tokenizer_path
from lodeframe.llm.scratch import written


def quality_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, accepts. Null and empty texts are
    scored as an empty text; without labels all rows stay; repeated rows stay or go together."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_copies_gone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest key. Null and empty texts link with nothing
    and stay; of repeated rows one stays."""
    return jaccard.one_of_each(docs)


def benchmark_gone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark. Null and empty texts and rows without a key stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_gone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark. Null and empty texts stay as they are."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, packed into sequences of at most 1024 tokens. Null and empty texts are the end id."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_kept),
    ("near duplicates", near_copies_gone),
    ("benchmark decontamination", benchmark_gone),
    ("secrets", secrets_gone),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
