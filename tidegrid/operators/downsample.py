"""Buckets of time, anchored at the start of a query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.aggregates import aggregate
from tidegrid.model import Downsample, Points, sortable


def downsampled(points: Points, spec: Downsample, start: int, end: int) -> DataFrame:
    """For each series and bucket that has data: bucket (its first second) and value.

    points are deduplicated and lie in [start, end); null values, such as first rates, count for nothing. One shuffle, by series and bucket,
    after partial aggregation.
    """
    interval = spec.interval or end - start
    if spec.reporting and spec.agg != "avg":
        raise ValueError("a number of reporting points goes with avg only")
    bucket = F.col("ts") - (F.col("ts") - F.lit(start)) % F.lit(interval)
    df = points.df.where(F.col("value").isNotNull()).withColumn("bucket", bucket)
    if spec.drop_partial:
        df = df.where(F.col("bucket") + interval <= end)
    value = F.sum("value") / F.lit(spec.reporting) if spec.reporting else aggregate(spec.agg, F.col("value"), F.col("ts"))
    if spec.infectious:
        value = F.when(F.count("value") == interval, value)
    out = df.groupBy(*points.series, "bucket").agg(value.alias("value"))
    if spec.infectious:
        out = out.where(F.col("value").isNotNull())
    return filled(out, points.series, start, end, interval, spec.drop_partial, spec.agg) if spec.fill else out


def filled(buckets: DataFrame, series: Sequence[str], start: int, end: int, interval: int, drop_partial: bool = True, agg: str | None = None) -> DataFrame:
    """buckets with a row, of null value (of 0 for counts), for each bucket of [start, end) that a series lacks.

    Each row stands for itself and the empty buckets up to the next one, so that the grid is never joined or gathered.
    """
    count = (end - start) // interval if drop_partial else -(-(end - start) // interval)
    final = start + (count - 1) * interval
    ordered = Window.partitionBy(*sortable(buckets, list(series))).orderBy("bucket")
    first = F.when(F.lag("bucket").over(ordered).isNull(), F.lit(start).cast("bigint")).otherwise(F.col("bucket"))
    last = F.coalesce(F.lead("bucket").over(ordered) - interval, F.lit(final).cast("bigint"))
    spread = buckets.withColumns({"lo": first, "hi": last}).withColumn("b", F.explode(F.sequence("lo", "hi", F.lit(interval).cast("bigint"))))
    return spread.select(*series, F.col("b").alias("bucket"), F.when(F.col("b") == F.col("bucket"), F.col("value")).otherwise(0.0 if agg == "count" else None).cast("double").alias("value"))


def as_arrays(buckets: DataFrame, series: Sequence[str]) -> DataFrame:
    """Each series' values as one array by time."""
    pairs = F.array_sort(F.collect_list(F.struct("bucket", "value")))
    return buckets.groupBy(*series).agg(F.min("bucket").alias("start"), F.transform(pairs, lambda p: p["value"]).alias("values"))
