"""Datapoints and events out of the star schema's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.model import Points, Tags


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; wall-clock times are read as UTC, whatever the session's time zone, and so that filters on them reach the files."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    fields = [T.StructField(f.name, T.TimestampType() if f.dataType == T.TimestampNTZType() else f.dataType, f.nullable) for f in df.schema.fields]
    return df if fields == df.schema.fields else spark.read.schema(T.StructType(fields)).parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def clicks(spark: SparkSession, sf_dir: str, coarse: int = 1) -> Points:
    """events as datapoints: the event type is the metric, user and k (from props) are tags. coarse: seconds that ts is cut to."""
    e = table(spark, sf_dir, "events")
    ts = epoch(F.col("ts"))
    df = e.select(
        F.col("event_type").alias("metric"), F.col("user_id").cast("string").alias("user"), F.get_json_object("props", "$.k").alias("k"),
        (ts - ts % coarse if coarse > 1 else ts).alias("ts"), F.col("value").cast("double").alias("value"), F.col("event_id").alias("seq"), *([] if coarse > 1 else [F.col("ts").alias("_at")]),
    )
    return Points(df, Tags({"user": "user", "k": "k"}), None if coarse > 1 else "_at")


def user_clicks(spark: SparkSession, sf_dir: str) -> Points:
    """events with the user as the only tag: longer series."""
    p = clicks(spark, sf_dir)
    return Points(p.df.drop("k"), Tags({"user": "user"}), p.at)


def prices(spark: SparkSession, sf_dir: str) -> Points:
    """lineitem's prices by day, with the return flag, status and supplier as tags; many points share a series and a day."""
    li = table(spark, sf_dir, "lineitem")
    df = li.select(
        F.lit("sales.price").alias("metric"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").cast("string").alias("supplier"),
        epoch(F.col("l_shipdate")).alias("ts"), F.col("l_extendedprice").cast("double").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_shipdate").alias("_at"),
    )
    return Points(df, Tags({"flag": "flag", "status": "status", "supplier": "supplier"}), "_at")


def operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as operational events; those of an even k go on until ten minutes later, every event of k 7 hasn't ended."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    ts = epoch(F.col("ts"))
    none = F.lit(None).cast("string")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("namespace"), F.lit("web").alias("source"),
        F.concat(F.lit("Seen "), F.col("event_type")).alias("title"), F.concat_ws(" ", F.lit("User"), F.col("user_id").cast("string"), F.lit("Value"), F.floor("value").cast("string")).alias("message"),
        none.alias("priority"), F.col("user_id").cast("string").alias("user_id"), ts.alias("ts"), F.when(k.cast("int") % 2 == 0, ts + 600).alias("end_ts"), (k == "7").alias("ongoing"),
        F.when(F.col("event_type") != "view", F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))).alias("dimensions"),
        F.create_map(F.lit("k"), k).alias("additional_props"),
        F.when(F.col("event_id") % 10 != 0, F.array((F.col("event_id") - F.col("event_id") % 10).cast("string"))).otherwise(F.array().cast("array<string>")).alias("parent_ids"),
    )


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as events, for searches in longer texts; a turn is a minute."""
    c = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"), F.col("role").alias("namespace"), F.lit("chat").alias("source"), none.alias("title"),
        F.col("text").alias("message"), none.alias("priority"), F.col("conv_id").cast("string").alias("user_id"), (F.col("conv_id") * 86400 + F.col("turn") * 60).alias("ts"), F.lit(None).cast("bigint").alias("end_ts"),
        F.lit(False).alias("ongoing"), F.create_map(F.lit("role"), F.col("role")).alias("dimensions"), F.lit(None).cast("map<string,string>").alias("additional_props"), F.array().cast("array<string>").alias("parent_ids"),
    )
