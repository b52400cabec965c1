"""Series combined by tags, bucket by bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.aggregates import aggregate
from tidegrid.model import Tags


#: What an aggregate of several stores is made from.
PARTS = {**{a: (a,) for a in ("sum", "count", "min", "max", "sumofsquare")}, "avg": ("sum", "count"), "dev": ("sum", "count", "sumofsquare"), "range": ("min", "max")}


def grouped(buckets: DataFrame, tags: Tags, by: Sequence[str], agg: str) -> DataFrame:
    """The values of all series of a metric that agree in the tags of by, combined for each bucket.

    Series are downsampled before, so that an average is one of the series' averages. Series that lack one of the tags are in no group.
    """
    keys = [tags.value(k).alias(k) for k in by]
    rows = buckets
    for k in by:
        rows = rows.where(tags.has(k))
    return rows.groupBy("metric", *keys, "bucket").agg(aggregate(agg, F.col("value"), F.col("bucket")).alias("value"))


def partial(buckets: DataFrame, tags: Tags, by: Sequence[str], agg: str) -> DataFrame:
    """What grouped() of one store must say of each group and bucket so that several stores' answers can be merged()."""
    if agg not in PARTS:
        raise ValueError(f"{agg} can't be made from several stores' answers")
    rows = buckets
    for k in by:
        rows = rows.where(tags.has(k))
    return rows.groupBy("metric", *[tags.value(k).alias(k) for k in by], "bucket").agg(*[aggregate(p, F.col("value"), F.col("bucket")).alias(p) for p in PARTS[agg]])


def merged(partials: Sequence[DataFrame], keys: Sequence[str], agg: str) -> DataFrame:
    """partial() answers of the same query over several stores as one: averages weigh by counts. What sums, counts and extremes don't determine, as percentiles, can't be merged."""
    if agg not in PARTS:
        raise ValueError(f"{agg} can't be made from several stores' answers")
    rows = partials[0]
    for more in partials[1:]:
        rows = rows.unionByName(more)
    all_ = {p: {"min": F.min, "max": F.max}.get(p, F.sum)(p) for p in PARTS[agg]}
    if agg == "avg":
        value = all_["sum"] / all_["count"]
    elif agg == "dev":
        value = F.sqrt(F.greatest(all_["sumofsquare"] / all_["count"] - F.pow(all_["sum"] / all_["count"], 2), F.lit(0.0)))
    elif agg == "range":
        value = all_["max"] - all_["min"]
    else:
        value = all_[agg]
    return rows.groupBy(*keys, "bucket").agg(value.alias("value"))


def merged_groups(results: DataFrame) -> DataFrame:
    """Groups of series from several stores: rows of group (a map of tags) and series (an array of ids) with one group become one."""
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("group"))))
    return results.groupBy(key.alias("k")).agg(F.first("group").alias("group"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("series")))).alias("series")).drop("k")
