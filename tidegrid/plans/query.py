"""Metric queries: what is asked, and the plan that answers it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.filters import Filter, MatchAll, fold
from tidegrid.model import Downsample, Points, Rate
from tidegrid.operators import groupby, rollup, series
from tidegrid.operators.downsample import downsampled, filled
from tidegrid.operators.rate import parted, rates


@dataclass(frozen=True)
class Query:
    metric: str | None = None
    start: int = 0
    end: int = 0
    where: Filter = MatchAll()
    shift: int = 0
    rate: Rate | None = None
    downsample: Downsample | None = None
    group_by: tuple[str, ...] | None = None
    group_agg: str = "sum"


@dataclass(frozen=True)
class Store:
    """What a query may be answered from: the points, and rollups of them by interval, each with its aggregates."""

    points: Points
    rollups: Sequence[tuple[int, Sequence[str], DataFrame]] = field(default_factory=tuple)


def chosen_rollup(query: Query, store: Store) -> tuple[int, Sequence[str], DataFrame] | None:
    """The coarsest rollup that gives the exact answer."""
    if query.downsample is None or query.rate is not None:
        return None
    fit = [r for r in store.rollups if rollup.answers(query.downsample, query.start - query.shift, query.end - query.shift, r[0], r[1])]
    return max(fit, key=lambda r: r[0], default=None)


def planned(query: Query, store: Store) -> DataFrame:
    """Filter, range, shift, deduplication, rate, downsampling, grouping, in this order; a rollup takes the place of the first steps if one fits.

    Without downsampling the result has ts, else bucket.
    """
    points = store.points
    tags = points.tags
    wanted = fold(query.where, tags)
    if query.metric is not None:
        wanted = (F.col("metric") == query.metric) & wanted
    spec = query.downsample
    if found := chosen_rollup(query, store):
        rows = found[2].where(wanted)
        if query.shift:
            rows = rows.withColumn("slot", F.col("slot") + F.lit(query.shift))
        out = rollup.from_rollup(rows, points.series, spec, query.start, query.end)
        if spec.fill:
            out = filled(out, points.series, query.start, query.end, spec.interval, spec.drop_partial, spec.agg)
    else:
        points = points.on(points.df.where(wanted))
        points = series.shifted(points, query.shift, query.start, query.end) if query.shift else series.in_range(points, query.start, query.end)
        points = series.deduped(parted(points) if query.rate else points)
        if query.rate:
            points = rates(points, query.rate)
        if spec is None:
            if query.group_by is None:
                return points.df.select(*points.series, "ts", "value")
            return groupby.grouped(points.df.withColumnRenamed("ts", "bucket"), tags, query.group_by, query.group_agg).withColumnRenamed("bucket", "ts")
        out = downsampled(points, spec, query.start, query.end)
    return out if query.group_by is None else groupby.grouped(out, tags, query.group_by, query.group_agg)
