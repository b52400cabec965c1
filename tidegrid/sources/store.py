"""Stores of datapoints, rollups, series and events: Parquet by day, which queries prune by their range."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.aggregates import ROLLUP
from tidegrid.functions.filters import Filter, MatchAll, fold
from tidegrid.model import SEGMENT, Points, Tags, sortable
from tidegrid.operators.meta import series_id
from tidegrid.operators.rollup import rolled_up
from tidegrid.operators.series import deduped

DAY = 86400


def _by_day(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("day", F.to_date(F.timestamp_seconds(ts)))


def _days(start: int, end: int):
    """The predicate that prunes days; it follows from one on ts, but Spark doesn't derive it."""
    day = lambda t: F.to_date(F.timestamp_seconds(F.lit(t)))
    return (F.col("day") >= day(start)) & (F.col("day") <= day(max(start, end - 1)))


def write_points(points: Points, path: str, mode: str = "append") -> None:
    """Files by day, in which series lie together, so that filters on metrics and tags skip row groups.

    Rows are cut into ranges of even size, so that a metric, a day or a series with most of the points is several tasks'.
    """
    df = _by_day(points.between(None, None).df, "ts")
    order = ["day", *sortable(df, points.series), "ts"]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("day").parquet(path)


def read_points(spark: SparkSession, path: str, tags: Tags, start: int | None = None, end: int | None = None) -> Points:
    df = spark.read.parquet(path)
    if start is not None and end is not None:
        df = df.where(_days(start, end) & (F.col("ts") >= start) & (F.col("ts") < end))
    return Points(df.drop("day"), tags)


def flush(points: Points, paths: Sequence[str], now: int, frequency: int, rollup: int | None = None, width: int = SEGMENT) -> int:
    """Writes the segment that now - frequency lies in, deduplicated (or rolled up), to each store, and gives its first second.

    The segment's folder is replaced, so that flushing again, after a failure or for late points, leaves one copy.
    """
    segment = (now - frequency) // width * width
    inside = deduped(points.on(points.df.where((F.col("ts") >= segment) & (F.col("ts") < segment + width))))
    out = rolled_up(inside, rollup, ROLLUP, width) if rollup else inside.df
    for path in paths:
        out.write.mode("overwrite").parquet(f"{path}/segment={segment}")
    return segment


def write_rollup(points: Points, path: str, interval: int, aggs: Sequence[str] = ROLLUP, width: int = SEGMENT, mode: str = "append") -> None:
    df = _by_day(rolled_up(points, interval, aggs, width), "slot")
    order = ["day", *sortable(df, points.series), "slot"]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("day").parquet(path)


def read_rollup(spark: SparkSession, path: str, start: int, end: int, aggs: Sequence[str] | None = None) -> DataFrame:
    """The rollup's rows from start to end; only the aggregates asked for are read."""
    df = spark.read.parquet(path).where(_days(start, end) & (F.col("slot") >= start) & (F.col("slot") < end))
    gone = [] if aggs is None else [c for c in ROLLUP if c not in aggs and c in df.columns]
    return df.drop("day", *gone)


def write_catalog(series: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The series catalog as compressed lines of JSON."""
    series.write.mode(mode).option("compression", "gzip").json(path)


def read_catalog(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_series(points: Points, path: str, mode: str = "overwrite") -> None:
    """The series dimension: each series, its id, and the days in which it has points."""
    present = points.df.where(F.col("value").isNotNull() & ~F.isnan("value"))
    days = present.groupBy(*points.series).agg(F.array_sort(F.collect_set(F.to_date(F.timestamp_seconds("ts")))).alias("days"))
    days.withColumn("series_id", series_id(points.tags)).write.mode(mode).parquet(path)


def read_series_points(spark: SparkSession, path: str, series_path: str, tags: Tags, start: int, end: int, where: Filter = MatchAll(), metric: str | None = None) -> Points:
    """The points of the series that pass, looked up in the series dimension first: only days in which one of them has points are read, and only rows of their ids stay."""
    wanted = fold(where, tags)
    if metric is not None:
        wanted = (F.col("metric") == metric) & wanted
    first, last = (F.to_date(F.timestamp_seconds(F.lit(t))) for t in (start, max(start, end - 1)))
    found = spark.read.parquet(series_path).where(wanted).select("series_id", F.filter("days", lambda d: (d >= first) & (d <= last)).alias("days")).where(F.size("days") > 0)
    days = [r[0] for r in found.select(F.explode("days")).distinct().collect()]  # at most the days of the range
    p = read_points(spark, path, tags, start, end)
    df = spark.read.parquet(path).where(F.col("day").isin(days) & (F.col("ts") >= start) & (F.col("ts") < end)).drop("day")
    df = df.withColumn("series_id", series_id(tags)).join(found.select("series_id"), "series_id", "left_semi").drop("series_id")
    return p.on(df.where(wanted))


_KEPT: dict[tuple[str, ...], str] = {}


def kept(spark: SparkSession, *name: str, write: Callable[[str], None]) -> str:
    """The path of a store that an application writes once and reads from then on, in the folder that all executors share."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _KEPT:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tidegrid-")
        path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
        write(path)
        _KEPT[key] = path
    return _KEPT[key]


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    df = _by_day(events, "ts").repartitionByRange("day", "namespace", "ts", "event_id")
    df.sortWithinPartitions("day", "namespace", "ts").write.mode(mode).partitionBy("day").parquet(path)


def read_events(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Events that begin in the days of [start, end]; one that goes on is in the day in which it began."""
    return spark.read.parquet(path).where(_days(start, end + 1)).drop("day")
