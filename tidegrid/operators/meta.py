"""Discovery: which metrics, tags and series there are. What is counted is series, each one metric with one set of tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.filters import Explicit, Filter, MatchAll, algebra
from tidegrid.model import Points, Tags

#: How many rows a discovery query shows unless told otherwise.
LIMIT = 1024


def catalog(points: Points) -> DataFrame:
    """A row for each series: its columns, tag_count, the last second and value, and a 64-bit id."""
    tags = points.tags
    present = points.df.where(F.col("value").isNotNull() & ~F.isnan("value"))
    out = present.groupBy(*points.series).agg(F.max("ts").alias("last_ts"), F.max_by("value", F.struct("ts", "seq")).alias("last_value"))
    return out.withColumns({"tag_count": tags.count(), "series_id": series_id(tags)})


def series_id(tags: Tags) -> Column:
    """A 64-bit hash of the metric and all tags."""
    return F.xxhash64("metric", F.to_json(F.array_sort(tags.pairs())))


def matching(series: DataFrame, tags: Tags, where: Filter = MatchAll()) -> DataFrame:
    return series.where(F.coalesce(algebra(where, tags), F.lit(False)))


def _limited(df: DataFrame, limit: int | None, *order: str) -> DataFrame:
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def metrics(series: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    return _limited(series.groupBy("metric").agg(F.count("*").alias("series")), limit, "metric")


def namespaces(series: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """What stands before the first dot of metrics."""
    name = F.substring_index("metric", ".", 1)
    return _limited(series.groupBy(name.alias("namespace")).agg(F.count("*").alias("series")), limit, "namespace")


def timeseries(series: DataFrame, tags: Tags, limit: int | None = LIMIT) -> DataFrame:
    """metric and tags (a JSON object by key) of each series."""
    entries = F.array_sort(tags.pairs())
    shown = series.select("metric", F.to_json(F.map_from_entries(entries)).alias("tags"))
    return _limited(shown, limit, "metric", "tags")


def _pairs(series: DataFrame, tags: Tags, only: str | None) -> DataFrame:
    rows = series.select(F.explode(tags.pairs()).alias("p")).select(F.col("p.key").alias("key"), F.col("p.value").alias("value"))
    return rows.where(F.col("key") == only) if only is not None else rows


def tag_keys(series: DataFrame, tags: Tags, only: str | None = None, limit: int | None = LIMIT) -> DataFrame:
    return _limited(_pairs(series, tags, only).groupBy("key").agg(F.count("*").alias("series")), limit, "key")


def tag_values(series: DataFrame, tags: Tags, only: str | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Values of different keys count as one."""
    return _limited(_pairs(series, tags, only).groupBy("value").agg(F.count("*").alias("series")), limit, "value")


def keys_and_values(series: DataFrame, tags: Tags, only: str | None = None, limit: int | None = LIMIT) -> DataFrame:
    """key, value, series, and key_series, the key's total. A key is shown with all its values or not at all."""
    counts = _pairs(series, tags, only).groupBy("key", "value").agg(F.count("*").alias("series"))
    totals = counts.groupBy("key").agg(F.sum("series").alias("key_series"), F.count("*").alias("n"))
    if limit is not None:  # keys are few: their running total is taken over the small table
        totals = totals.withColumn("upto", F.sum("n").over(Window.orderBy("key"))).where(F.col("upto") <= limit)
    return counts.join(totals.select("key", "key_series"), "key").select("key", "value", "series", "key_series")


def hits(series: DataFrame, tags: Tags, where: Filter = MatchAll()) -> DataFrame:
    """The number of series with explicit tags, else of distinct sets of tags."""
    if isinstance(where, Explicit):
        return series.agg(F.count("*").alias("hits"))
    return series.select(*tags.names).distinct().agg(F.count("*").alias("hits"))


def grouped_series(series: DataFrame, tags: Tags, by: Sequence[str]) -> DataFrame:
    """metric, the tags of by and series_id of each series that has all of them: rows, not arrays, as a group may hold most series."""
    rows = series
    for k in by:
        rows = rows.where(tags.has(k))
    return rows.select("metric", *[tags.value(k).alias(k) for k in by], "series_id")


def merged(results: Sequence[DataFrame]) -> DataFrame:
    """One discovery result from those of several stores that share no series: what is counted is added up by name, and by key as well; lists of series follow one another."""
    rows = results[0]
    for more in results[1:]:
        rows = rows.unionByName(more)
    counts = [c for c in ("series", "hits") if c in rows.columns]
    if not counts:
        return rows
    names = [c for c in rows.columns if c not in (*counts, "key_series")]
    out = rows.groupBy(*names).agg(*[F.sum(c).alias(c) for c in counts])
    if "key_series" in rows.columns:
        out = out.join(out.groupBy("key").agg(F.sum("series").alias("key_series")), "key").select(*rows.columns)
    return out
