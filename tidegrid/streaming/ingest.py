"""Ingest of datapoints as a stream: late and early points, segments, last values that expire."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.functions.aggregates import ROLLUP, aggregate
from tidegrid.model import SEGMENT, Points, sortable
from tidegrid.operators.meta import series_id
from tidegrid.operators.series import deduped

ON_TIME, LATE, EARLY = "on_time", "late", "early"
#: An ephemeral segment opens so long before its time and closes so long after.
OPENS_BEFORE, CLOSES_AFTER = 30, 900


def arrival(now: Column, retention: int, width: int = SEGMENT) -> Column:
    """Whether a point comes late (its segment is no longer kept), early (its segment is to come) or on time."""
    segment = F.col("ts") - F.col("ts") % width
    hour = now - now % 3600
    return F.when(F.floor((hour - segment) / 3600) > retention // 3600, LATE).when(segment > hour, EARLY).otherwise(ON_TIME)


def ephemeral_arrival(now: Column, width: int = SEGMENT) -> Column:
    """The same where only the current segment is kept: open from shortly before it begins until some time after it ended."""
    segment = F.col("ts") - F.col("ts") % width
    return F.when(now >= segment + width + CLOSES_AFTER, LATE).when(now < segment - OPENS_BEFORE, EARLY).otherwise(ON_TIME)


def counted(points: DataFrame, status: Column) -> DataFrame:
    return points.groupBy(status.alias("status")).agg(F.count("*").alias("points"))


def ingest(points: Points, path: str, checkpoint: str, now: Callable[[], int], retention: int, width: int = SEGMENT, told: Callable[[int, dict[str, int]], None] | None = None) -> DataStreamWriter:
    """A writer of a stream's points on time, deduplicated within each batch, below path by batch and day.

    A batch that is run again replaces its own folder, so that each point is stored once; what several batches have of one second is for readers to deduplicate.
    told is called after each batch with its number and how many points came on_time, late and early, counted while they were written.
    """

    def store(batch: DataFrame, number: int) -> None:
        seen = Observation()
        status = F.col("status")
        marked = batch.withColumn("status", arrival(F.lit(now()), retention, width)).observe(seen, *[F.count_if(status == s).alias(s) for s in (ON_TIME, LATE, EARLY)])
        kept = points.on(marked.where(status == ON_TIME).drop("status"))
        out = deduped(kept).df.withColumn("day", F.to_date(F.timestamp_seconds("ts")))
        out.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={number}")
        if told:
            told(number, seen.get)

    return points.df.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def admitted(points: Points, known: DataFrame, cap: int) -> Points:
    """The points of known series (a catalog with series_id), and of as many new ones, the earliest first, as make cap series in all; other new series are turned away."""
    df = points.between(None, None).df.withColumn("series_id", series_id(points.tags))
    ids = known.select("series_id").distinct()
    new = df.groupBy("series_id", *points.series).agg(F.min("ts").alias("first")).join(ids, "series_id", "left_anti")
    first = new.orderBy("first", *sortable(new, points.series)).limit(max(0, cap - ids.count())).select("series_id")
    return points.on(df.join(ids.union(first), "series_id", "left_semi").drop("series_id"))


def segment_rollups(points: Points, width: int = SEGMENT, delay: int = CLOSES_AFTER) -> DataFrame:
    """Each series' aggregates of whole segments, given out once a segment is closed; its state then goes. Of points of one second the one written last counts."""
    timed = points.df.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{delay} seconds")
    once = timed.groupBy(*points.series, "ts", F.window("at", f"{width} seconds").alias("w")).agg(F.max_by("value", "seq").alias("value"))
    segment = F.window(F.window_time("w"), f"{width} seconds")
    out = once.groupBy(*points.series, segment.alias("s")).agg(*[aggregate(a, F.col("value"), F.col("ts")).alias(a) for a in ROLLUP])
    return out.select(*points.series, F.unix_timestamp("s.start").alias("segment"), *ROLLUP)


def live_last_values(points: Points, idle: int, delay: int = CLOSES_AFTER) -> DataFrame:
    """A stream of each series' last value as it changes; a series without points for idle seconds is forgotten, with a row that says so.

    Time only moves forward: of points of one second the one written last counts, whichever batch has it, unless it comes
    delay seconds behind the stream; earlier seconds change nothing.
    """
    keys = points.series
    types = dict(points.df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", last_ts bigint, last_value double, expired boolean"

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda ts, value, expired: pd.DataFrame([[*key, ts, value, expired]], columns=[*keys, "last_ts", "last_value", "expired"])
        if state.hasTimedOut:
            ts, value, _ = state.get
            state.remove()
            yield row(ts, value, True)
            return
        best = state.get if state.exists else None
        for frame in frames:
            latest = frame.iloc[np.lexsort((frame["seq"], frame["ts"]))[-1]]
            if best is None or (latest["ts"], latest["seq"]) >= (best[0], best[2]):
                best = int(latest["ts"]), float(latest["value"]), int(latest["seq"])
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] * 1000 + idle * 1000, state.getCurrentWatermarkMs() + 1))
        yield row(best[0], best[1], False)

    timed = points.df.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{delay} seconds")
    return timed.groupBy(*keys).applyInPandasWithState(step, schema, "last_ts bigint, last_value double, last_seq bigint", "update", GroupStateTimeout.EventTimeTimeout)


def purged(points: Points, now: int, retention: int, slack: int = 600, width: int = SEGMENT) -> Points:
    """The points left after segments beyond the retention, and some slack, are gone."""
    gone = now - retention - width - slack  # the last second that a segment which is gone may begin in
    return points.between((gone // width + 1) * width, None)


def idle_series(catalog: DataFrame, now: int, span: int) -> DataFrame:
    """The series without points for span seconds, whose entries may go."""
    return catalog.where(F.col("last_ts") < now - span)
