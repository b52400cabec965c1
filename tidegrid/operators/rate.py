"""Rates of deduplicated points, taken before downsampling and only from points inside the query's range.

A series is cut into parts of a day, so that no task has to take a long one whole. Points move once, to their part, where they are deduplicated and ordered; what a part's first point
needs, the last point before it, comes from a table of one row for each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.model import SEGMENT, Points, Rate, sortable

#: Seconds of a series that lie together.
PART = 86400
#: Bytes of the files read that one partition is meant for, at most. Partitions that Spark puts together hold several times as much, in each of a task's sorts and aggregates.
SLICE = 8 << 20
KEY, AT = "_key", "_part"


def _together(df: DataFrame, *keys: str) -> DataFrame:
    """df with equal keys in one partition, as many of them as the files it reads are large; of small ones Spark chooses."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    n = -(-sum(x for x in sizes if x < 1 << 60) // SLICE)  # Spark gives the largest number to what it knows nothing of
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)


def parted(points: Points, width: int = PART) -> Points:
    """points where parts of series lie together. The key is a hash; where two series have the same, they share partitions, nothing else."""
    df = points.df.withColumns({KEY: F.xxhash64(*sortable(points.df, points.series)), AT: F.floor(F.col("ts") / width)})
    return points.on(_together(df, KEY, AT))


def _before(points: Points, spec: Rate) -> DataFrame:
    """By KEY and AT, an array of a struct for each series there: its columns (s), second and value of its last point in earlier parts, and its usual gap, if that is asked for."""
    own = [KEY, *sortable(points.df, points.series)]
    ends = _together(points.df.groupBy(*points.series, KEY, AT).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value")), KEY)
    earlier = Window.partitionBy(*own).orderBy(AT)
    out = ends.select(KEY, AT, F.struct(*sortable(ends, points.series)).alias("s"), F.lag("ts").over(earlier).alias("ts"), F.lag("value").over(earlier).alias("value"))
    if spec.to_count and spec.data_interval is None:
        # A segment is never cut by a part, so all gaps within segments are there.
        inside = Window.partitionBy(KEY, AT, *own[1:]).orderBy("ts")
        gaps = points.df.select(KEY, F.struct(*own[1:]).alias("s"), F.floor(F.col("ts") / SEGMENT).alias("g"), (F.col("ts") - F.lag("ts").over(inside)).alias("gap"), F.lag("ts").over(inside).alias("b"))
        gaps = gaps.where(F.floor(F.col("b") / SEGMENT) == F.col("g")).groupBy(KEY, "s", "gap").agg(F.count("*").alias("n"))
        usual = gaps.groupBy(KEY, "s").agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("usual")).groupBy(KEY).agg(F.collect_list(F.struct("s", "usual")).alias("all"))
        out = out.join(usual, KEY, "left").select(KEY, AT, "s", "ts", "value", F.get(F.filter("all", lambda x: x["s"].eqNullSafe(F.col("s"))), F.lit(0))["usual"].alias("usual"))
    else:
        out = out.withColumn("usual", F.lit(None).cast("bigint"))
    return _together(out, KEY, AT).groupBy(KEY, AT).agg(F.collect_list(F.struct("s", "ts", "value", "usual")).alias("before"))


def rates(points: Points, spec: Rate) -> Points:
    """points with each value replaced by its rate against the series' point before; the first one's is null.

    to_count goes before delta_only, and this before counters. The gap that to_count takes is, for each series, the most frequent one
    between points of one segment, of equally frequent ones the least.
    """
    if KEY not in points.df.columns:
        points = parted(points)
    names = sortable(points.df, points.series)
    inside = Window.partitionBy(KEY, AT, *names).orderBy("ts")
    df = points.df.withColumns({"own": F.struct(*names), "last": F.lag("value").over(inside), "last_ts": F.lag("ts").over(inside)})
    df = df.join(_before(points, spec), [KEY, AT], "left")
    mine = F.get(F.filter("before", lambda x: x["s"].eqNullSafe(F.col("own"))), F.lit(0))
    df = df.withColumn("mine", mine).withColumns({"last": F.coalesce("last", "mine.value"), "gap": F.col("ts") - F.coalesce("last_ts", "mine.ts"), "usual": F.col("mine.usual")})
    v, last = F.col("value"), F.col("last")
    dr = F.col("gap") / F.lit(spec.interval)
    delta = v - last
    if spec.to_count:
        if spec.data_interval is not None:
            usual = F.lit(max(1, spec.data_interval // spec.interval))
        else:
            usual = F.greatest(F.lit(1), F.floor(F.coalesce(F.col("usual"), F.lit(0)) / spec.interval))
        value = v * F.least(dr, usual.cast("double"))
    elif spec.delta_only:
        value = delta
    else:
        value = delta / dr
        if spec.counter:
            jump = F.lit(spec.counter_max) - last + v
            wrapped = jump / dr
            if spec.reset_value > 0:
                wrapped = F.when(jump > spec.reset_value, F.lit(0.0 if spec.on_reset == "zero" else None).cast("double")).otherwise(wrapped)
            value = F.when(delta < 0, F.lit(None).cast("double") if spec.drop_resets else wrapped).otherwise(value)
    df = df.withColumn("value", F.when(last.isNotNull(), value))
    return points.on(df.drop(KEY, AT, "own", "last", "last_ts", "before", "mine", "gap", "usual"))
