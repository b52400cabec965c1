"""Rollups: several aggregates of each series and interval, kept for later queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.aggregates import ROLLUP, aggregate, chain
from tidegrid.model import ROLLUP_INTERVALS, SEGMENT, SEGMENT_WIDTHS, Downsample, Points

#: The rollup columns that each aggregate is made from again.
NEEDS = {"sum": {"sum"}, "count": {"count"}, "min": {"min"}, "max": {"max"}, "sumofsquare": {"sumofsquare"}, "avg": {"sum", "count"}}


def rolled_up(points: Points, interval: int, aggs: Sequence[str] = ROLLUP, width: int = SEGMENT) -> DataFrame:
    """For each series, segment and interval (from the segment's start on) with data: the aggregates. points are deduplicated."""
    chain(aggs)
    if interval not in ROLLUP_INTERVALS or width not in SEGMENT_WIDTHS or width % interval and width > interval:
        raise ValueError("no such rollup interval or segment width")
    within = F.col("ts") % width
    slot = F.col("ts") - within % interval
    segment = F.col("ts") - within
    columns = [aggregate(a, F.col("value"), F.col("ts")).alias(a) for a in aggs]
    return points.df.groupBy(*points.series, segment.alias("segment"), slot.alias("slot")).agg(*columns)


def answers(spec: Downsample, start: int, end: int, interval: int, aggs: Sequence[str]) -> bool:
    """Whether a rollup gives exactly what downsampling the points would: no interval of it may reach beyond either end of what is asked."""
    wide = spec.interval
    cut = end % interval and not spec.drop_partial
    return bool(wide and wide % interval == 0 and start % interval == 0 and not cut and not spec.infectious and (NEEDS.get(spec.agg) or {None}) <= set(aggs))


def from_rollup(rollup: DataFrame, series: Sequence[str], spec: Downsample, start: int, end: int) -> DataFrame:
    """downsampled() from a rollup that answers it: averages are weighted by their counts, counts are added."""
    df = rollup.where((F.col("slot") >= start) & (F.col("slot") < end)).withColumn("bucket", F.col("slot") - (F.col("slot") - F.lit(start)) % F.lit(spec.interval))
    if spec.drop_partial:
        df = df.where(F.col("bucket") + spec.interval <= end)
    again = {"min": F.min, "max": F.max}
    if spec.agg == "avg":
        value = F.sum("sum") / (F.lit(spec.reporting) if spec.reporting else F.sum("count"))
    else:
        value = again.get(spec.agg, F.sum)(spec.agg)
    return df.groupBy(*series, "bucket").agg(value.alias("value"))
