"""Scans of datapoints: ranges, last write wins, shifts, tiers, last values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.model import SEGMENT, Points


def in_range(points: Points, start: int, end: int) -> Points:
    """start <= ts < end."""
    return points.between(start, end)


def retained(points: Points, now: int, retention: int) -> Points:
    """Points of the segments that are still kept at now."""
    first = now - now % SEGMENT - retention
    return points.between(-(-first // SEGMENT) * SEGMENT, None)


def shifted(points: Points, shift: int, start: int, end: int) -> Points:
    """Points of shift seconds before [start, end), relabelled into it."""
    earlier = in_range(points, start - shift, end - shift)
    return points.on(earlier.df.withColumn("ts", F.col("ts") + F.lit(shift)))


def deduped(points: Points) -> Points:
    """One point for each series and second, the one written last; missing values (null, NaN) never win or stay."""
    present = points.df.where(F.col("value").isNotNull() & ~F.isnan("value"))
    parts = [c for c in ("_key", "_part") if c in present.columns]  # where rates have put the points
    return points.on(present.groupBy(*points.series, *parts, "ts").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq")))


def last_values(points: Points):
    """The latest second of each series and its last written value."""
    present = points.df.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return present.groupBy(*points.series).agg(F.max("ts").alias("last_ts"), F.max_by("value", F.struct("ts", "seq")).alias("last_value"))


def one_series(points: Points, metric: str, tags: dict[str, str]) -> Points:
    """The points of the series with exactly these tags."""
    wanted: Column = (F.col("metric") == metric) & (points.tags.count() == len(tags))
    for key, value in tags.items():
        wanted = wanted & (points.tags.value(key) == value)
    return points.on(points.df.where(F.coalesce(wanted, F.lit(False)))).between(None, None)


def tiered(hot: Points, cold: Points, cut: int) -> Points:
    """Points from cut on of the hot tier, earlier ones of the cold tier."""
    hot = hot.between(cut, None)
    return hot.on(hot.df.unionByName(cold.between(None, cut).df))


def heartbeat(points: Points, start: int, end: int, interval: int = 60):
    """The first and last bucket with data in [start, end) and how many have some, by metric."""
    bucket = F.lit(start) + F.floor((F.col("ts") - start) / interval) * interval
    found = in_range(points, start, end).df.where(F.col("value").isNotNull())
    return found.groupBy("metric", bucket.alias("b")).agg(F.lit(1).alias("n")).groupBy("metric").agg(F.min("b").alias("earliest"), F.max("b").alias("latest"), F.count("*").alias("buckets"))


def segments(points: Points, width: int = SEGMENT):
    """The segments in which each series has data, with their number of points: what tells which files a query needs."""
    return points.df.groupBy(*points.series, (F.col("ts") - F.col("ts") % width).alias("segment")).agg(F.count("*").alias("points"))
