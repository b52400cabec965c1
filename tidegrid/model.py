"""The data model: datapoints with tags, and the specifications that queries are made of.

A datapoint has a metric, tags, an epoch second, a double and a sequence number, which says in what order points were written.
Tags that queries often name are plain columns, so that filters on them reach the Parquet scan; any others are in a map column.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths that a rollup may have, in seconds.
ROLLUP_INTERVALS = (5, 10, 15, 30, 60, 300, 600, 900, 1800, 3600, 86400)
#: Widths that a segment may have, in seconds.
SEGMENT_WIDTHS = (3600, 7200, 6 * 3600, 86400, 7 * 86400)
SEGMENT = 7200
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(span: int | str) -> int:
    """Seconds of a span such as 30, "30s", "5m", "2h"."""
    if isinstance(span, str):
        found = re.fullmatch(r"(\d+)([smhdw])", span)
        if not found:
            raise ValueError(f"not a time span: {span}")
        span = int(found[1]) * _UNITS[found[2]]
    if span <= 0:
        raise ValueError("a time span must be positive")
    return span


@dataclass(frozen=True)
class Tags:
    """Where tags are: key to column, and the map column with the rest, if there is one. A null value means that the tag is missing."""

    columns: Mapping[str, str] = field(default_factory=dict)
    rest: str | None = None

    def value(self, key: str) -> Column:
        if key in self.columns:
            return F.col(self.columns[key])
        return F.col(self.rest)[key] if self.rest else F.lit(None).cast("string")

    def has(self, key: str) -> Column:
        return self.value(key).isNotNull()

    def count(self) -> Column:
        n = F.lit(0)
        for name in self.columns.values():
            n = n + F.col(name).isNotNull().cast("int")
        return n + F.coalesce(F.size(self.rest), F.lit(0)) if self.rest else n

    def pairs(self) -> Column:
        """An array of structs key, value with the tags that are there."""
        own = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in self.columns.items()]), lambda x: x["value"].isNotNull())
        if not self.rest:
            return own
        more = F.coalesce(F.map_entries(self.rest), F.array().cast("array<struct<key:string,value:string>>"))
        return F.concat(own, more) if self.columns else more

    @property
    def names(self) -> list[str]:
        return [*self.columns.values(), *([self.rest] if self.rest else [])]


@dataclass(frozen=True)
class Points:
    """Datapoints: columns metric, the tags' columns, ts (epoch seconds), value, seq."""

    df: DataFrame
    tags: Tags
    #: A timestamp column of df that ts is the second of. Ranges are put on it too, as it is what files know.
    at: str | None = None

    @property
    def series(self) -> list[str]:
        """The columns that make a series."""
        return ["metric", *self.tags.names]

    def on(self, df: DataFrame) -> Points:
        return Points(df, self.tags, self.at if self.at in df.columns else None)

    def between(self, start: int | None, end: int | None) -> Points:
        """The points with start <= ts < end; at has then done its part and goes."""
        df = self.df
        for limit, within in ((start, lambda c, v: c >= v), (end, lambda c, v: c < v)):
            if limit is not None:
                df = df.where(within(F.col("ts"), F.lit(limit)))
                if self.at:
                    df = df.where(within(F.col(self.at), F.timestamp_seconds(F.lit(limit))))
        return Points(df.drop(self.at) if self.at else df, self.tags)


def sortable(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns as what windows and sorts take: maps, which have no order, as text."""
    kinds = dict(df.dtypes)
    return [F.to_json(F.array_sort(F.map_entries(n))) if kinds[n].startswith("map") else F.col(n) for n in names]


@dataclass(frozen=True)
class Rate:
    """How a rate is taken: per interval seconds, from one point of a series to the next."""

    interval: int = 1
    delta_only: bool = False
    counter: bool = False
    counter_max: float = float(2**63 - 1)
    reset_value: float = 0.0
    drop_resets: bool = False
    #: What a counter's jump beyond reset_value becomes: "zero" or "null".
    on_reset: str = "zero"
    to_count: bool = False
    #: Seconds between points, for to_count; None: each series' most frequent gap within a segment.
    data_interval: int | None = None


@dataclass(frozen=True)
class Downsample:
    """Buckets of interval seconds from a query's start on; None: one bucket for all of it."""

    agg: str = "avg"
    interval: int | None = 60
    drop_partial: bool = True
    #: Only buckets with a value in each second count.
    infectious: bool = False
    #: For avg: the sum is divided by this number of points instead of those there are.
    reporting: int | None = None
    #: Give empty buckets too, with null.
    fill: bool = False
