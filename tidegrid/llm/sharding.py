"""Proportional stratified interleaving: shards that each have the mixture of the whole table.

Rows are shuffled by a seeded key within their stratum (source) and ranked there. Rank r of n gives the
fraction (2r - 1) / 2n; ordering all rows by it interleaves the strata in proportion, and equal cuts of the fraction
give shards in which each stratum has its share, to within one row.

Only keys are ranked, not rows: they are sorted as a whole in ranges of even size, whichever stratum, id or key is hot, and a row's rank
follows from its place in its range and the ranges' counts. The rows themselves move once, to meet their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.shared import shuffle_key, slots, stored, without


def shards(docs: DataFrame, id_col: str = "doc_id", stratum: str = "source", rows_per_shard: int = 10_000, seed: int = 7) -> DataFrame:
    """All rows and columns of docs with shard (from 0) and position in the shard (from 1).

    Null strata form a stratum of their own; null ids are shuffled by a hash of the row. Rows that tie in the key are ordered by a
    hash of all their columns, so that only identical rows are interchangeable. An empty table gives no rows. A column
    named shard or position comes back as shard_input or position_input. Texts are looked at by that hash only.
    """
    spark = docs.sparkSession
    docs = without(docs, ["shard", "position"])
    names = docs.columns
    hashed = [f.name for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in hashed])
    key = F.when(F.col(f"`{id_col}`").isNotNull(), shuffle_key(seed, f"`{id_col}`")).otherwise(F.md5(F.concat(F.lit(f"{seed}:null:"), tie.cast("string"))))
    hot = F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string")), F.lit("-"))
    slim = docs.select(hot.alias("s"), key.alias("k"), tie.alias("tie"))
    # A place is the range's number and, below, the row's number in it; it is stored, since ranges may be cut otherwise when they are cut again.
    ranges = slots(spark, docs)
    ordered = stored(spark, slim.repartitionByRange(ranges, "s", "k", "tie").sortWithinPartitions("s", "k", "tie").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = ordered.groupBy("s", part.alias("part")).agg(F.count("*").alias("c"), F.min("at").alias("first"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    starts = stored(spark, counts.select("s", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"), F.sum("c").over(Window.partitionBy("s")).alias("n")))
    cuts = max(1, -(-(starts.groupBy("s").agg(F.first("n").alias("n")).agg(F.sum("n")).first()[0] or 0) // rows_per_shard))
    ranked = ordered.withColumn("part", part).join(starts, ["s", "part"]).withColumn("r", F.col("at") + F.col("shift"))
    placed = ranked.select("s", "k", "tie", "r", F.expr(f"((2 * r - 1) * {cuts}L) div (2 * n)").alias("shard"), ((2 * F.col("r") - 1) / (2 * F.col("n"))).alias("f"))
    placed = placed.withColumn("position", F.row_number().over(Window.partitionBy("shard").orderBy("f", "s", "r")).cast("bigint"))
    same = Window.partitionBy("k", "tie", "s")
    placed = placed.select("k", "tie", "s", "shard", "position", F.row_number().over(same.orderBy("r")).alias("copy"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("k"), tie.alias("tie"), hot.alias("s")).withColumn("copy", F.row_number().over(same.orderBy(F.lit(0))))
    return rows.join(placed, ["k", "tie", "s", "copy"]).select(*[F.col(f"row.`{c}`").alias(c) for c in names], "shard", "position")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path)


ORACLE = """
WITH keyed AS (
  SELECT *, coalesce('=' || source, '-') AS s_, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k_ FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s_ ORDER BY k_, doc_id) AS r_, count(*) OVER (PARTITION BY s_) AS n_,
         greatest(1, (count(*) OVER () + 9999) // 10000) AS cuts_ FROM keyed
), placed AS (
  SELECT *, CAST(((2 * r_ - 1) * cuts_) // (2 * n_) AS BIGINT) AS shard, CAST(2 * r_ - 1 AS DOUBLE) / (2 * n_) AS f_ FROM ranked
)
SELECT doc_id, text, lang, source, n_chars, shard, row_number() OVER (PARTITION BY shard ORDER BY f_, s_, r_) AS position FROM placed
"""
