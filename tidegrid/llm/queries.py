"""The queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import jaccard, media, packing, phrases, pictures, pieces, quality, sharding, suffixes, toxicity, warc
from tidegrid.llm.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(pictures.drawn(table(spark, sf_dir, "pages"), "page_id", "html"), "page_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, toxicity.kinds(table(spark, sf_dir, "labels")), toxicity.KINDS))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), decoded=True)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_round_trip(spark, table(spark, sf_dir, "pages"), shared_folder(spark))


def op9_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.similar(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_media": op1_media,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_jaccard": op5_jaccard,
    "op6_pieces": op6_pieces,
    "op7_suffixes": op7_suffixes,
    "op8_warc": op8_warc,
    "op9_phrases": op9_phrases,
    "op10_sharding": op10_sharding,
}

ORACLES = {"op5_jaccard": jaccard.ORACLE, "op7_suffixes": suffixes.ORACLE, "op8_warc": warc.ORACLE, "op10_sharding": sharding.ORACLE}
