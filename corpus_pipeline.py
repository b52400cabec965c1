"""A corpus pipeline: toxicity, quality, near duplicates, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import jaccard, packing, pieces, quality, suffixes, toxicity
from tidegrid.llm.shared import deleted, scratch, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic. Null and empty texts stay, each row is judged by itself, an empty table stays empty, further columns are kept."""
    labels = toxicity.kinds(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels, toxicity.KINDS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality, by their text and their site, is good. Null and empty texts are judged as texts of no words, null sources and languages are sites of their own; an empty table stays empty, further columns are kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar n-gram sets link, the one with the least doc_id (null last). Texts without words all stay; of rows that repeat in id and text one stays; an empty table stays empty, further columns are kept."""
    return jaccard.one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand before, in this or another document. Rows all stay, with null and empty texts as they are; an empty table stays empty, further columns are kept."""
    return suffixes.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each training sequence holds, in tokens of the default vocabulary. Documents without tokens (null or empty texts) have no row, null ids are kept; an empty table gives no rows."""
    return packing.pack(pieces.counted(docs), F.col("n_pieces"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]

#: The fitted models have no SQL; tests/llm/test_pipeline.py holds run() and its stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's result written as Parquet and read again by the next, after which it goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            deleted(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
