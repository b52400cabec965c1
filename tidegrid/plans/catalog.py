"""The engine's queries over whole tables, and for each the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.filters import AND, NOT, OR, AnyField, Chain, Explicit, Filter, Literal, MatchAll, Metric, Regexp, TagKey, Wildcard, parsed
from tidegrid.functions.aggregates import ROLLUP
from tidegrid.model import SEGMENT, Downsample, Points, Rate
from tidegrid.operators import downsample, events, groupby, meta, rollup, series
from tidegrid.plans import registry
from tidegrid.plans.query import Query, Store, planned
from tidegrid.sources import store, tables
from tidegrid.streaming import ingest

FLAGSHIP = "rate_ds_groupby"
#: All of January 2024 holds the events table, from 1995 to 2001 is that of lineitem.
START, END = 1704067200, 1706745600
SALES_START, SALES_END = 788918400, 1009843200
HOUR, DAY, WEEK = 3600, 86400, 7 * 86400

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

POINTS = """pts AS (
  SELECT event_type AS metric, CAST(user_id AS VARCHAR) AS "user", json_extract_string(props, '$.k') AS k, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, event_id AS seq FROM events)"""
USERS = """pts AS (SELECT event_type AS metric, CAST(user_id AS VARCHAR) AS "user", CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, event_id AS seq FROM events)"""
SALES = """pts AS (
  SELECT 'sales.price' AS metric, l_returnflag AS flag, l_linestatus AS status, CAST(l_suppkey AS VARCHAR) AS supplier, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts,
         l_extendedprice AS value, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""
SERIES = POINTS + """, series AS (
  SELECT metric, "user", k, max(ts) AS last_ts, arg_max(value, struct_pack(ts := ts, seq := seq)) AS last_value, 2 AS tag_count FROM pts GROUP BY ALL),
pairs AS (SELECT metric, 'user' AS key, "user" AS value FROM series UNION ALL SELECT metric, 'k', k FROM series)"""
EVENTS = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS namespace, 'Seen ' || event_type AS title,
         'User ' || user_id || ' Value ' || CAST(floor(value) AS BIGINT) AS message, CAST(user_id AS VARCHAR) AS user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + 600 END AS end_ts, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') = '7' AS ongoing,
         CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS d_user, CASE WHEN event_type <> 'view' THEN event_type END AS d_kind,
         CASE WHEN event_id % 10 <> 0 THEN CAST(event_id - event_id % 10 AS VARCHAR) END AS parent FROM events)"""


def query(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order in the last places."""
    return df.withColumns({c: F.round(c, 6) for c in columns or ["value"]})


def clicks(spark: SparkSession, sf_dir: str) -> Store:
    return Store(tables.clicks(spark, sf_dir))


def users(spark: SparkSession, sf_dir: str) -> Store:
    return Store(tables.user_clicks(spark, sf_dir))


def sales(spark: SparkSession, sf_dir: str) -> Store:
    return Store(tables.prices(spark, sf_dir))


# Scans

query("raw_scan", f"WITH {POINTS} SELECT metric, \"user\", k, ts, arg_max(value, seq) AS value FROM pts WHERE ts >= {START} AND ts < {END} GROUP BY ALL")(
    lambda s, d: planned(Query(None, START, END), clicks(s, d))
)
query("last_value", f"WITH {USERS} SELECT metric, \"user\", max(ts) AS last_ts, arg_max(value, struct_pack(ts := ts, seq := seq)) AS last_value FROM pts GROUP BY ALL")(
    lambda s, d: series.last_values(users(s, d).points)
)
query("dedupe_last_write", f"WITH {SALES} SELECT metric, flag, status, supplier, ts, arg_max(value, seq) AS value, max(seq) AS seq FROM pts GROUP BY ALL")(
    lambda s, d: series.deduped(sales(s, d).points).df
)
query("segment_assign", f"WITH {USERS} SELECT metric, \"user\", ts - ts % {SEGMENT} AS segment, count(*) AS points FROM pts GROUP BY ALL")(
    lambda s, d: series.segments(users(s, d).points)
)
query("one_series", f"WITH {USERS} SELECT metric, \"user\", ts, value, seq FROM pts WHERE metric = 'click' AND \"user\" = '7'")(
    lambda s, d: series.one_series(users(s, d).points, "click", {"user": "7"}).df
)
query("heartbeat", f"WITH {USERS}, b AS (SELECT DISTINCT metric, {START} + (ts - {START}) // 3600 * 3600 AS b FROM pts) SELECT metric, min(b) AS earliest, max(b) AS latest, count(*) AS buckets FROM b GROUP BY metric")(
    lambda s, d: series.heartbeat(users(s, d).points, START, END, HOUR)
)
query("retention_filter", f"WITH {USERS} SELECT * FROM pts WHERE ts - ts % {SEGMENT} >= {END - END % SEGMENT - 10 * DAY}")(
    lambda s, d: series.retained(users(s, d).points, END, 10 * DAY).df
)
query("tier_union", f"WITH {USERS} SELECT * FROM pts")(
    lambda s, d: series.tiered(users(s, d).points, users(s, d).points, START + 20 * DAY).df
)


# Filters: the deduplicated points that pass

def filtered(name: str, tree: Filter, sql: str) -> None:
    query(name, f"WITH {POINTS} SELECT metric, \"user\", k, ts, arg_max(value, seq) AS value FROM pts WHERE {sql} GROUP BY ALL")(
        lambda s, d: planned(Query(None, START, END, tree), clicks(s, d))
    )


filtered("filter_literal", Literal(None, "user", ("1", "2", "3")), "\"user\" IN ('1', '2', '3')")
filtered("filter_regex", Regexp(None, "user", "1[0-4]$"), "regexp_matches(\"user\", '1[0-4]$')")
filtered("filter_wildcard", Wildcard("user", "1*4"), "regexp_matches(\"user\", '1.*4')")
filtered("filter_match_all", MatchAll(), "true")
filtered("filter_not", Literal(NOT, "k", ("5", "6")), "k NOT IN ('5', '6')")
filtered(
    "filter_chain",
    Chain(None, (Literal(AND, "k", tuple(map(str, range(40)))), Regexp(OR, "user", "^1"), Literal(AND, "user", tuple(map(str, range(1, 90)))), Literal(NOT, "k", ("3",)))),
    f"(k IN ({', '.join(repr(str(i)) for i in range(40))}) OR regexp_matches(\"user\", '^1')) AND \"user\" IN ({', '.join(repr(str(i)) for i in range(1, 90))}) AND k <> '3'",
)
filtered("filter_only_nots", Chain(None, (Literal(NOT, "k", ("3",)), Regexp(NOT, "user", "9"))), "NOT (k = '3' OR regexp_matches(\"user\", '9'))")
filtered("filter_explicit", Explicit(None, Chain(None, (Regexp(AND, "user", ".*"), Literal(AND, "k", ("1", "2"))))), "k IN ('1', '2')")
filtered("filter_explicit_too_few", Explicit(None, Literal(None, "k", ("1", "2"))), "false")
filtered(
    "filter_parsed",
    parsed({"type": "Chain", "op": "AND", "filters": [{"type": "TagValueLiteralOr", "tagKey": "k", "filter": "1|2|3"}, {"type": "NOT", "filter": {"type": "TagValueRegex", "tagKey": "user", "filter": "5"}}]}),
    "k IN ('1', '2', '3') AND NOT regexp_matches(\"user\", '5')",
)


# Downsampling

def bucketed(name: str, spec: Downsample, value: str, where: str = "true", having: str = "true") -> None:
    i = spec.interval or END - START
    partial = f"b + {i} <= {END}" if spec.drop_partial else "true"
    sql = f"""WITH {USERS}, d AS (SELECT metric, "user", ts, arg_max(value, seq) AS value FROM pts WHERE {where} GROUP BY ALL),
b AS (SELECT *, {START} + (ts - {START}) // {i} * {i} AS b FROM d)
SELECT metric, "user", b AS bucket, round({value}, 6) AS value FROM b WHERE {partial} GROUP BY ALL HAVING {having}"""
    query(name, sql)(lambda s, d: rounded(planned(Query(None, START, END, downsample=spec), users(s, d))))


for agg, sql in {
    "sum": "sum(value)", "avg": "avg(value)", "count": "CAST(count(*) AS DOUBLE)", "min": "min(value)", "max": "max(value)", "last": "arg_max(value, ts)", "first": "arg_min(value, ts)",
    "median": "quantile_cont(value, 0.5)", "p99": "quantile_cont(value, 0.99)", "dev": "stddev_pop(value)", "sumofsquare": "sum(value * value)", "range": "max(value) - min(value)",
}.items():
    bucketed(f"ds_{agg}", Downsample(agg, 6 * HOUR), sql)
bucketed("ds_runall", Downsample("avg", None), "avg(value)")
bucketed("ds_reporting_avg", Downsample("avg", DAY, reporting=24), "sum(value) / 24")
bucketed("ds_drop_partial", Downsample("sum", 9 * DAY), "sum(value)")
bucketed("ds_keep_partial", Downsample("sum", 9 * DAY, drop_partial=False), "sum(value)")

query(
    "ds_infectious",
    f"""WITH {USERS}, h AS (SELECT metric, ts - ts % 21600 AS ts, arg_max(value, seq) AS value FROM pts GROUP BY ALL), b AS (SELECT *, ts // 21600 AS i FROM h)
SELECT metric, i - i % 4 AS bucket, round(sum(value), 6) AS value FROM b WHERE i - i % 4 + 4 <= {END // 21600} GROUP BY ALL HAVING count(value) = 4""",
)(lambda s, d: infectious(s, d))


def infectious(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a point in each quarter; quarters of days take the part of seconds."""
    p = tables.clicks(spark, sf_dir, 6 * HOUR)
    p = Points(p.df.drop("user", "k"), type(p.tags)())
    p = series.deduped(p)
    p = p.on(p.df.withColumn("ts", F.expr("ts div 21600")))
    return rounded(downsample.downsampled(p, Downsample("sum", 4, infectious=True), START // (6 * HOUR), END // (6 * HOUR)))


query(
    "ds_fill",
    f"""WITH {USERS}, d AS (SELECT metric, "user", ts, arg_max(value, seq) AS value FROM pts GROUP BY ALL),
b AS (SELECT metric, "user", {START} + (ts - {START}) // {DAY} * {DAY} AS bucket, sum(value) AS value FROM d GROUP BY ALL),
grid AS (SELECT DISTINCT metric, "user", unnest(range({START}, {END}, {DAY})) AS bucket FROM b)
SELECT metric, "user", bucket, round(value, 6) AS value FROM grid LEFT JOIN b USING (metric, "user", bucket)""",
)(lambda s, d: rounded(planned(Query(None, START, END, downsample=Downsample("sum", DAY, fill=True)), users(s, d))))


query(
    "ds_fill_count",
    f"""WITH {USERS}, d AS (SELECT metric, "user", ts, arg_max(value, seq) AS value FROM pts GROUP BY ALL),
b AS (SELECT metric, "user", {START} + (ts - {START}) // {DAY} * {DAY} AS bucket, CAST(count(*) AS DOUBLE) AS value FROM d GROUP BY ALL),
grid AS (SELECT DISTINCT metric, "user", unnest(range({START}, {END}, {DAY})) AS bucket FROM b)
SELECT metric, "user", bucket, coalesce(value, 0) AS value FROM grid LEFT JOIN b USING (metric, "user", bucket)""",
)(lambda s, d: planned(Query(None, START, END, downsample=Downsample("count", DAY, fill=True)), users(s, d)))
query(
    "ds_arrays",
    f"""WITH {USERS}, d AS (SELECT metric, "user", ts, arg_max(value, seq) AS value FROM pts GROUP BY ALL),
b AS (SELECT metric, "user", {START} + (ts - {START}) // {DAY} * {DAY} AS bucket, round(sum(value), 6) AS value FROM d GROUP BY ALL)
SELECT metric, "user", min(bucket) AS start, list(value ORDER BY bucket) AS "values" FROM b GROUP BY ALL""",
)(lambda s, d: downsample.as_arrays(rounded(planned(Query(None, START, END, downsample=Downsample("sum", DAY)), users(s, d))), ["metric", "user"]))


# Rates

def rated(name: str, spec: Rate, value: str, source: str = "users") -> None:
    keys = '"user"' if source == "users" else "flag, status, supplier"
    sql = f"""WITH {USERS if source == "users" else SALES}, d AS (SELECT metric, {keys}, ts, arg_max(value, seq) AS v FROM pts GROUP BY ALL),
l AS (SELECT *, lag(v) OVER w AS p, CAST(ts - lag(ts) OVER w AS DOUBLE) / {spec.interval} AS dr, ts - lag(ts) OVER w AS gap FROM d WINDOW w AS (PARTITION BY metric, {keys} ORDER BY ts))
SELECT metric, {keys}, ts, CASE WHEN p IS NULL THEN NULL ELSE {value} END AS value FROM l"""
    start, end = (START, END) if source == "users" else (SALES_START, SALES_END)
    query(name, sql)(lambda s, d: planned(Query(None, start, end, rate=spec), (users if source == "users" else sales)(s, d)))


rated("rate", Rate(HOUR), "(v - p) / dr")
rated("rate_delta", Rate(delta_only=True), "v - p")
rated("rate_counter_reset", Rate(HOUR, counter=True, counter_max=1000.0), "CASE WHEN v < p THEN (1000.0 - p + v) / dr ELSE (v - p) / dr END")
rated("rate_drop_resets", Rate(HOUR, counter=True, drop_resets=True), "CASE WHEN v < p THEN NULL ELSE (v - p) / dr END")
rated("rate_reset_value", Rate(HOUR, counter=True, counter_max=1000.0, reset_value=980.0), "CASE WHEN v < p THEN CASE WHEN 1000.0 - p + v > 980 THEN 0 ELSE (1000.0 - p + v) / dr END ELSE (v - p) / dr END")
rated("rate_reset_null", Rate(HOUR, counter=True, counter_max=1000.0, reset_value=980.0, on_reset="null"), "CASE WHEN v < p THEN CASE WHEN 1000.0 - p + v > 980 THEN NULL ELSE (1000.0 - p + v) / dr END ELSE (v - p) / dr END")
rated("rate_to_count", Rate(HOUR, to_count=True, data_interval=2 * HOUR), "v * least(dr, 2.0)")
rated("rate_sales", Rate(DAY), "(v - p) / dr", "sales")
query(
    "rate_to_count_inferred",
    f"""WITH {USERS}, d AS (SELECT metric, ts, arg_max(value, seq) AS v FROM pts GROUP BY ALL),
l AS (SELECT *, lag(v) OVER w AS p, ts - lag(ts) OVER w AS gap FROM d WINDOW w AS (PARTITION BY metric ORDER BY ts)),
n AS (SELECT metric, gap, count(*) AS c FROM l WHERE gap IS NOT NULL AND ts // {SEGMENT} = (ts - gap) // {SEGMENT} GROUP BY ALL),
u AS (SELECT metric, arg_max(gap, struct_pack(c := c, g := -gap)) AS usual FROM n GROUP BY metric)
SELECT metric, ts, round(CASE WHEN p IS NOT NULL THEN v * least(CAST(gap AS DOUBLE) / 60, CAST(greatest(1, coalesce(usual, 0) // 60) AS DOUBLE)) END, 6) AS value FROM l LEFT JOIN u USING (metric)""",
)(lambda s, d: rounded(inferred(s, d)))


def inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.user_clicks(spark, sf_dir)
    return planned(Query(None, START, END, rate=Rate(60, to_count=True)), Store(Points(p.df.drop("user"), type(p.tags)())))


# Groups, shifts

def combined(name: str, agg: str, value: str) -> None:
    sql = f"""WITH {SALES}, d AS (SELECT metric, flag, status, supplier, ts, arg_max(value, seq) AS value FROM pts GROUP BY ALL),
b AS (SELECT metric, flag, status, supplier, {SALES_START} + (ts - {SALES_START}) // {WEEK} * {WEEK} AS bucket, avg(value) AS value FROM d GROUP BY ALL)
SELECT metric, flag, status, bucket, round({value}, 6) AS value FROM b WHERE bucket + {WEEK} <= {SALES_END} GROUP BY ALL"""
    query(name, sql)(lambda s, d: rounded(planned(Query("sales.price", SALES_START, SALES_END, downsample=Downsample("avg", WEEK), group_by=("flag", "status"), group_agg=agg), sales(s, d))))


for agg, sql in {"sum": "sum(value)", "avg": "avg(value)", "min": "min(value)", "max": "max(value)", "count": "CAST(count(*) AS DOUBLE)", "p95": "quantile_cont(value, 0.95)"}.items():
    combined(f"groupby_{agg}", agg, sql)

query(
    "rate_ds_groupby",
    f"""WITH {SALES}, d AS (SELECT metric, flag, status, supplier, ts, arg_max(value, seq) AS v FROM pts GROUP BY ALL),
r AS (SELECT *, (v - lag(v) OVER w) / (CAST(ts - lag(ts) OVER w AS DOUBLE) / {DAY}) AS r FROM d WINDOW w AS (PARTITION BY metric, flag, status, supplier ORDER BY ts)),
b AS (SELECT metric, flag, status, supplier, {SALES_START} + (ts - {SALES_START}) // {WEEK} * {WEEK} AS bucket, sum(r) AS value FROM r WHERE r IS NOT NULL GROUP BY ALL)
SELECT metric, flag, bucket, round(avg(value), 6) AS value FROM b WHERE bucket + {WEEK} <= {SALES_END} GROUP BY ALL""",
)(lambda s, d: rounded(planned(Query("sales.price", SALES_START, SALES_END, rate=Rate(DAY), downsample=Downsample("sum", WEEK), group_by=("flag",), group_agg="avg"), sales(s, d))))
query("groupby_raw", f"WITH {SALES}, d AS (SELECT metric, flag, status, supplier, ts, arg_max(value, seq) AS value FROM pts GROUP BY ALL) SELECT metric, flag, ts, round(sum(value), 6) AS value FROM d GROUP BY ALL")(
    lambda s, d: rounded(planned(Query("sales.price", SALES_START, SALES_END, group_by=("flag",)), sales(s, d)))
)
query(
    "time_shift",
    f"""WITH {USERS}, d AS (SELECT metric, "user", ts + {WEEK} AS ts, arg_max(value, seq) AS value FROM pts WHERE ts < {END - WEEK} GROUP BY ALL)
SELECT metric, "user", {START} + (ts - {START}) // {DAY} * {DAY} AS bucket, round(avg(value), 6) AS value FROM d GROUP BY ALL""",
)(lambda s, d: rounded(planned(Query(None, START, END, shift=WEEK, downsample=Downsample("avg", DAY)), users(s, d))))
query(
    "week_over_week",
    f"""WITH {USERS}, d AS (SELECT metric, "user", ts, arg_max(value, seq) AS value FROM pts GROUP BY ALL),
b AS (SELECT metric, {START} + (ts - {START}) // {DAY} * {DAY} AS bucket, sum(value) AS value FROM (SELECT metric, "user", ts, value FROM d) GROUP BY ALL)
SELECT n.metric, n.bucket, round(n.value - o.value, 6) AS value FROM b n JOIN b o ON n.metric = o.metric AND n.bucket = o.bucket + {WEEK}""",
)(lambda s, d: rounded(week_over_week(s, d)))


def week_over_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda shift: planned(Query(None, START, END, shift=shift, downsample=Downsample("sum", DAY), group_by=(), group_agg="sum"), users(spark, sf_dir))
    now, old = one(0), one(WEEK)
    return now.join(old.withColumnRenamed("value", "old"), ["metric", "bucket"]).select("metric", "bucket", (F.col("value") - F.col("old")).alias("value"))


query(
    "merge_stores",
    f"""WITH {USERS}, d AS (SELECT metric, "user", ts, arg_max(value, seq) AS value FROM pts GROUP BY ALL)
SELECT metric, {START} + (ts - {START}) // {DAY} * {DAY} AS bucket, CAST(count(*) AS DOUBLE) AS value FROM d GROUP BY ALL""",
)(lambda s, d: merge_stores(s, d))


def merge_stores(spark: SparkSession, sf_dir: str, agg: str = "count") -> DataFrame:
    """Answers of two stores, each with the points of half of January, cut within a day."""
    cut = START + 15 * DAY + 7 * HOUR
    parts = []
    for a, b in ((START, cut), (cut, END)):
        p = series.in_range(tables.user_clicks(spark, sf_dir), a, b)
        raw = series.deduped(p).df.withColumn("bucket", F.col("ts") - (F.col("ts") - START) % DAY)
        parts.append(groupby.partial(raw, p.tags, (), agg))
    return groupby.merged(parts, ["metric"], agg)


for agg, sql in {"avg": "avg(value)", "dev": "stddev_pop(value)", "range": "max(value) - min(value)"}.items():
    query(
        f"merge_stores_{agg}",
        f"""WITH {USERS}, d AS (SELECT metric, "user", ts, arg_max(value, seq) AS value FROM pts GROUP BY ALL)
SELECT metric, {START} + (ts - {START}) // {DAY} * {DAY} AS bucket, round({sql}, 6) AS value FROM d GROUP BY ALL""",
    )(lambda s, d, agg=agg: rounded(merge_stores(s, d, agg)))


# Rollups

AGGREGATES = "avg(value) AS avg, sum(value) AS sum, CAST(count(*) AS DOUBLE) AS count, min(value) AS min, max(value) AS max, sum(value * value) AS sumofsquare"
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ROLLUP)
query(
    "rollup_all_aggs",
    f"""WITH {USERS}, d AS (SELECT metric, "user", ts, arg_max(value, seq) AS value FROM pts GROUP BY ALL),
r AS (SELECT metric, "user", ts - ts % {SEGMENT} AS segment, ts - ts % 900 AS slot, {AGGREGATES} FROM d GROUP BY ALL) SELECT metric, "user", segment, slot, {ROUNDED} FROM r""",
)(lambda s, d: rounded(rollup.rolled_up(series.deduped(users(s, d).points), 900), *ROLLUP))


def with_rollup(spark: SparkSession, sf_dir: str) -> Store:
    """The points, and rollups of them that are written once and read by day."""
    points = tables.user_clicks(spark, sf_dir)
    rollups = []
    for interval, aggs in ((900, ROLLUP), (HOUR, ("sum", "count"))):
        path = store.kept(spark, sf_dir, f"rollup{interval}", write=lambda p: store.write_rollup(series.deduped(points), p, interval, aggs))  # noqa: B023
        rollups.append((interval, aggs, store.read_rollup(spark, path, START, END)))
    return Store(points, rollups)


def stored_points(spark: SparkSession, sf_dir: str) -> str:
    return store.kept(spark, sf_dir, "points", write=lambda p: store.write_points(tables.user_clicks(spark, sf_dir), p))


def stored_users(spark: SparkSession, sf_dir: str, start: int, end: int) -> Points:
    return store.read_points(spark, stored_points(spark, sf_dir), tables.user_clicks(spark, sf_dir).tags, start, end)


query("stored_scan", f"WITH {USERS} SELECT metric, \"user\", ts, arg_max(value, seq) AS value FROM pts WHERE ts >= {START + 5 * DAY} AND ts < {START + 9 * DAY} GROUP BY ALL")(
    lambda s, d: planned(Query(None, START + 5 * DAY, START + 9 * DAY), Store(stored_users(s, d, START + 5 * DAY, START + 9 * DAY)))
)
query(
    "stored_ds_avg",
    f"""WITH {USERS}, d AS (SELECT metric, "user", ts, arg_max(value, seq) AS value FROM pts WHERE metric = 'click' AND ts >= {START + 5 * DAY} AND ts < {START + 9 * DAY} GROUP BY ALL)
SELECT metric, "user", {START} + (ts - {START}) // {DAY} * {DAY} AS bucket, round(avg(value), 6) AS value FROM d GROUP BY ALL""",
)(lambda s, d: rounded(planned(Query("click", START + 5 * DAY, START + 9 * DAY, downsample=Downsample("avg", DAY)), Store(stored_users(s, d, START + 5 * DAY, START + 9 * DAY)))))
query("series_probe", f"WITH {USERS} SELECT * FROM pts WHERE metric = 'view' AND \"user\" IN ('1', '2', '3') AND ts >= {START + 5 * DAY} AND ts < {START + 15 * DAY}")(
    lambda s, d: probed(s, d).df
)


def probed(spark: SparkSession, sf_dir: str) -> Points:
    points = tables.user_clicks(spark, sf_dir)
    dimension = store.kept(spark, sf_dir, "series", write=lambda p: store.write_series(points, p))
    return store.read_series_points(spark, stored_points(spark, sf_dir), dimension, points.tags, START + 5 * DAY, START + 15 * DAY, Literal(None, "user", ("1", "2", "3")), "view")


query(
    "registry_tiers",
    f"""WITH {USERS}, d AS (SELECT metric, "user", ts, arg_max(value, seq) AS value FROM pts WHERE metric = 'click' GROUP BY ALL)
SELECT metric, "user", {START} + (ts - {START}) // {DAY} * {DAY} AS bucket, round(sum(value), 6) AS value FROM d GROUP BY ALL""",
)(lambda s, d: rounded(routed(s, d)))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """January out of a hot source of ten days, whose first replica is down, and a cold one by day."""
    known = registry.Registry()
    known.register(registry.Source("hot1", lambda: tables.user_clicks(spark, sf_dir), keeps=10 * DAY, healthy=False))
    known.register(registry.Source("hot2", lambda: tables.user_clicks(spark, sf_dir), keeps=10 * DAY))
    known.register(registry.Source("other", lambda: tables.user_clicks(spark, sf_dir), namespaces=frozenset({"sales"}), tier=1))
    known.register(registry.Source("cold", lambda: stored_users(spark, sf_dir, START, END), namespaces=frozenset({"click", "view"}), tier=1))
    wanted = Query("click", START, END, downsample=Downsample("sum", DAY))
    return planned(wanted, known.store(wanted, END))


query(
    "rollup_read_unaligned",
    f"""WITH {USERS}, d AS (SELECT metric, "user", ts, arg_max(value, seq) AS value FROM pts WHERE ts < {END - 400} GROUP BY ALL)
SELECT metric, "user", {START} + (ts - {START}) // {DAY} * {DAY} AS bucket, round(sum(value), 6) AS value FROM d GROUP BY ALL""",
)(lambda s, d: rounded(planned(Query(None, START, END - 400, downsample=Downsample("sum", DAY, drop_partial=False)), with_rollup(s, d))))


for agg, sql in {"avg": "avg(value)", "sum": "sum(value)", "count": "CAST(count(*) AS DOUBLE)", "min": "min(value)", "max": "max(value)", "sumofsquare": "sum(value * value)"}.items():
    query(
        f"rollup_read_{agg}",
        f"""WITH {USERS}, d AS (SELECT metric, "user", ts, arg_max(value, seq) AS value FROM pts GROUP BY ALL)
SELECT metric, "user", {START} + (ts - {START}) // {DAY} * {DAY} AS bucket, round({sql}, 6) AS value FROM d GROUP BY ALL""",
    )(lambda s, d, agg=agg: rounded(planned(Query(None, START, END, downsample=Downsample(agg, DAY)), with_rollup(s, d))))


# Discovery

def discovered(name: str, sql: str, f: Callable[[DataFrame, Points], DataFrame], where: Filter = MatchAll(), sql_where: str = "true") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = tables.clicks(spark, sf_dir)
        return f(meta.matching(meta.catalog(points), points.tags, where), points)

    prelude = SERIES.replace("FROM series UNION", f"FROM series WHERE {sql_where} UNION").replace("k FROM series)", f"k FROM series WHERE {sql_where})")
    query(name, f"WITH {prelude} {sql.format(where=sql_where)}")(run)


discovered("meta_catalog", 'SELECT metric, "user", k, last_ts, last_value, tag_count FROM series', lambda s, p: s.drop("series_id"))
discovered("meta_metrics", "SELECT metric, count(*) AS series FROM series GROUP BY metric", lambda s, p: meta.metrics(s))
discovered("meta_namespaces", "SELECT split_part(metric, '.', 1) AS namespace, count(*) AS series FROM series GROUP BY 1", lambda s, p: meta.namespaces(s))
discovered("meta_tag_keys", "SELECT key, count(*) AS series FROM pairs GROUP BY key", lambda s, p: meta.tag_keys(s, p.tags))
discovered("meta_tag_values", "SELECT value, count(*) AS series FROM pairs GROUP BY value", lambda s, p: meta.tag_values(s, p.tags, limit=None))
discovered("meta_agg_field", "SELECT value, count(*) AS series FROM pairs WHERE key = 'k' GROUP BY value", lambda s, p: meta.tag_values(s, p.tags, "k"))
discovered(
    "meta_keys_values",
    "SELECT key, value, count(*) AS series, CAST(sum(count(*)) OVER (PARTITION BY key) AS BIGINT) AS key_series FROM pairs GROUP BY key, value",
    lambda s, p: meta.keys_and_values(s, p.tags, limit=None),
)
discovered("meta_tag_values_limited", "SELECT value, count(*) AS series FROM pairs GROUP BY value ORDER BY value LIMIT 20", lambda s, p: meta.tag_values(s, p.tags, limit=20))
discovered(
    "meta_keys_values_limited",
    """, t AS (SELECT key, count(DISTINCT value) AS n, count(*) AS key_series FROM pairs GROUP BY key), u AS (SELECT *, sum(n) OVER (ORDER BY key) AS upto FROM t)
SELECT key, value, count(*) AS series, any_value(key_series) AS key_series FROM pairs JOIN u USING (key) WHERE upto <= 120 GROUP BY key, value""",
    lambda s, p: meta.keys_and_values(s, p.tags, limit=120),
)
discovered(
    "meta_not_chain",
    "SELECT metric, count(*) AS series FROM series WHERE {where} GROUP BY metric",
    lambda s, p: meta.metrics(s),
    Chain(NOT, (Literal(None, "k", ("1", "2", "3")), Metric(None, ("click",))), AND),
    "NOT (k IN ('1', '2', '3') AND metric = 'click')",
)
discovered(
    "meta_request",
    "SELECT metric, k, count(*) AS series FROM series WHERE {where} GROUP BY metric, k",
    lambda s, p: meta.grouped_series(s, p.tags, ("k",)).groupBy("metric", "k").agg(F.count("*").alias("series")),
    registry.meta_request("click", Explicit(None, Chain(None, (Regexp(None, "user", "^1"), Regexp(None, "k", ".*")))), "click", START, END, ("k",)).where,
    "metric = 'click' AND regexp_matches(\"user\", '^1')",
)
query("meta_merge", f"WITH {SERIES} SELECT key, value, count(*) AS series, CAST(sum(count(*)) OVER (PARTITION BY key) AS BIGINT) AS key_series FROM pairs GROUP BY key, value")(
    lambda s, d: merged_discovery(s, d)
)


def merged_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of three stores, which the series are dealt to by a hash."""
    points = tables.clicks(spark, sf_dir)
    series_ = meta.catalog(points)
    return meta.merged([meta.keys_and_values(series_.where(F.pmod("series_id", F.lit(3)) == k), points.tags, limit=None) for k in range(3)])


discovered(
    "meta_timeseries",
    """SELECT metric, '{{"k":"' || k || '","user":"' || "user" || '"}}' AS tags FROM series ORDER BY 1, 2 LIMIT 1024""",
    lambda s, p: meta.timeseries(s, p.tags),
)
discovered("meta_hits", 'SELECT count(*) AS hits FROM (SELECT DISTINCT "user", k FROM series)', lambda s, p: meta.hits(s, p.tags))
discovered("meta_hits_explicit", "SELECT count(*) AS hits FROM series WHERE k = '1'", lambda s, p: meta.hits(s, p.tags, Explicit()), Explicit(None, Chain(None, (Literal(None, "k", ("1",)), Regexp(None, "user", ".*")))), "k = '1'")
discovered("meta_any", "SELECT metric, count(*) AS series FROM series WHERE {where} GROUP BY metric", lambda s, p: meta.metrics(s), AnyField(None, "^1.$"), "(regexp_matches(\"user\", '^1.$') OR regexp_matches(k, '^1.$'))")
discovered("meta_any_not", "SELECT metric, count(*) AS series FROM series WHERE {where} GROUP BY metric", lambda s, p: meta.metrics(s), AnyField(NOT, "^1.$"), "NOT (regexp_matches(\"user\", '^1.$') OR regexp_matches(k, '^1.$'))")
discovered("meta_tagkey_regex", "SELECT metric, count(*) AS series FROM series GROUP BY metric", lambda s, p: meta.metrics(s), TagKey(None, (), "^us"))
discovered(
    "meta_chain_and",
    "SELECT metric, count(*) AS series FROM series WHERE {where} GROUP BY metric",
    lambda s, p: meta.metrics(s),
    Chain(None, (Metric(None, ("click",)), Metric(None, (), "^v"), Regexp(None, "user", "^1"), Literal(NOT, "k", ("1", "2"))), AND),
    "(metric = 'click' OR regexp_matches(metric, '^v')) AND regexp_matches(\"user\", '^1') AND k NOT IN ('1', '2')",
)
discovered(
    "meta_chain_or",
    "SELECT metric, count(*) AS series FROM series WHERE {where} GROUP BY metric",
    lambda s, p: meta.metrics(s),
    Chain(None, (Literal(None, "k", ("1",)), Regexp(None, "user", "^1"), Metric(NOT, ("view",))), OR),
    "(k = '1' OR regexp_matches(\"user\", '^1')) AND metric <> 'view'",
)
query(
    "meta_group_merge",
    """WITH g AS (SELECT event_type, user_id % 10 AS g, list_sort(list(DISTINCT user_id)) AS series FROM events GROUP BY ALL) SELECT event_type AS kind, CAST(g AS VARCHAR) AS g, series FROM g""",
)(lambda s, d: group_merge(s, d))


def group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    group = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("g"), (F.col("user_id") % 10).cast("string"))
    parts = e.groupBy("event_type", "user_id").agg(F.first(group).alias("group"), F.collect_set("user_id").alias("series"))
    return groupby.merged_groups(parts.select("group", "series")).select(F.col("group")["kind"].alias("kind"), F.col("group")["g"].alias("g"), "series")


# Events

WHEN = f"((ts BETWEEN {START} AND {END}) OR coalesce(end_ts BETWEEN {START} AND {END}, false) OR ongoing)"


def found(spark: SparkSession, sf_dir: str, text: str | None = None, namespace: str | None = None, start: int = START, end: int = END) -> DataFrame:
    return events.searched(tables.operational(spark, sf_dir), start, end, text, namespace)


query("events_search", f"WITH {EVENTS} SELECT event_id, namespace, message, ts FROM ev WHERE {WHEN} AND (contains(lower(message), '12') OR contains(k, '12') OR contains(d_user, '12') OR contains(user_id, '12')) AND NOT contains(namespace, 'click')")(
    lambda s, d: found(s, d, "12 NOT namespace:click").select("event_id", "namespace", "message", "ts")
)
query("events_search_regex", f"WITH {EVENTS} SELECT event_id FROM ev WHERE {WHEN} AND len(list_filter(regexp_extract_all(lower(message), '\\S+'), lambda w: regexp_matches(w, '^1.*3'))) > 0 AND contains(lower(title), 'seen')")(
    lambda s, d: found(s, d, "message:/^1.*3/ AND title:seen").select("event_id")
)
query("events_namespace", f"WITH {EVENTS} SELECT event_id FROM ev WHERE {WHEN} AND namespace = 'view'")(lambda s, d: found(s, d, None, "VIEW").select("event_id"))
query("events_time_range", f"WITH {EVENTS} SELECT event_id, ts, end_ts FROM ev WHERE ts BETWEEN {START + 5 * DAY} AND {START + 6 * DAY} OR coalesce(end_ts BETWEEN {START + 5 * DAY} AND {START + 6 * DAY}, false) OR ongoing")(
    lambda s, d: events.searched(s.read.parquet(stored_events(s, d)), START + 5 * DAY, START + 6 * DAY).select("event_id", "ts", "end_ts")
)
query("events_days", f"WITH {EVENTS} SELECT event_id, ts FROM ev WHERE ts >= {START + 5 * DAY} AND ts < {START + 7 * DAY} AND (ts <= {START + 6 * DAY} OR coalesce(end_ts BETWEEN {START + 5 * DAY} AND {START + 6 * DAY}, false) OR ongoing) AND contains(namespace, 'view')")(
    lambda s, d: events.searched(store.read_events(s, stored_events(s, d), START + 5 * DAY, START + 6 * DAY), START + 5 * DAY, START + 6 * DAY, events.query_of({"type": "Chain", "op": "AND", "filters": [{"type": "PassThrough", "filter": " namespace:view "}]})).select("event_id", "ts")
)


def stored_events(spark: SparkSession, sf_dir: str) -> str:
    return store.kept(spark, sf_dir, "events", write=lambda p: store.write_events(tables.operational(spark, sf_dir), p))


query("events_bool_mixed", f"WITH {EVENTS} SELECT event_id FROM ev WHERE {WHEN} AND contains(namespace, 'view') AND contains(k, '1')")(lambda s, d: found(s, d, "namespace:view AND k:1 OR message:12").select("event_id"))
query(
    "events_regex_group",
    f"WITH {EVENTS} SELECT event_id FROM ev WHERE {WHEN} AND (len(list_filter(regexp_extract_all(lower(message), '\\S+'), lambda w: regexp_matches(w, '^\\S+(12|34)$'))) > 0 OR contains(' ' || lower(title) || ' ', ' seen click '))",
)(lambda s, d: found(s, d, r'message:/^\S+(12|34)$/ "SEEN click"').select("event_id"))
query("events_needed", f"WITH {EVENTS} SELECT event_id FROM ev WHERE {WHEN} AND (contains(namespace, 'click') OR contains(namespace, 'view')) AND contains(lower(message), '7') AND NOT contains(k, '3')")(
    lambda s, d: found(s, d, "+namespace:(click view) +message:7 -k:3 title:nothing").select("event_id")
)
query("events_top", f"WITH {EVENTS} SELECT event_id, ts FROM ev WHERE {WHEN} ORDER BY ts DESC, event_id DESC LIMIT 10")(lambda s, d: events.top(found(s, d), 0).select("event_id", "ts"))
query("events_total_hits", f"WITH {EVENTS} SELECT count(*) AS hits FROM ev WHERE {WHEN} AND (contains(title, 'view') OR namespace = 'view')")(lambda s, d: events.total_hits(found(s, d, "title:view OR namespace:view")))
query("events_group", f"WITH {EVENTS} SELECT coalesce(d_kind, '_NO_GROUP') AS \"group\", count(*) AS hits FROM ev WHERE {WHEN} GROUP BY 1")(lambda s, d: events.grouped(found(s, d), "kind"))
query("events_group_last", f"WITH {EVENTS} SELECT coalesce(d_user, '_NO_GROUP') AS \"group\", count(*) AS hits, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS last_event_id, max(ts) AS last_ts FROM ev WHERE {WHEN} GROUP BY 1")(
    lambda s, d: events.grouped(found(s, d), "user", True).select("group", "hits", F.col("last.event_id").alias("last_event_id"), F.col("last.ts").alias("last_ts"))
)
query("events_last_event", f"""WITH {EVENTS}, g AS (SELECT coalesce(d_kind, '_NO_GROUP') AS "group", arg_max(struct_pack(e := event_id, m := message, n := namespace, u := user_id, x := end_ts, o := ongoing), struct_pack(t := ts, e := event_id)) AS l FROM ev WHERE {WHEN} GROUP BY 1)
SELECT "group", l.e AS event_id, l.m AS message, l.n AS namespace, l.u AS user_id, l.x AS end_ts, l.o AS ongoing FROM g""")(
    lambda s, d: events.grouped(found(s, d), "kind", True).select("group", *[F.col(f"last.{c}").alias(c) for c in ("event_id", "message", "namespace", "user_id", "end_ts", "ongoing")])
)
query("events_minute_count", f"WITH {EVENTS} SELECT ts - ts % 60 AS minute, CAST(count(*) AS DOUBLE) AS count FROM ev WHERE {WHEN} GROUP BY 1")(lambda s, d: events.per_minute(found(s, d)))
query("events_id", f"WITH {EVENTS} SELECT event_id AS old, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') || '_' || md5(namespace || '|web|' || CASE WHEN d_user IS NULL THEN '{{}}' ELSE '{{\"kind\":\"' || d_kind || '\",\"user\":\"' || d_user || '\"}}' END || '|' || ts) AS new FROM ev")(
    lambda s, d: tables.operational(s, d).select(F.col("event_id").alias("old"), events.event_id(F.col("namespace"), F.col("source"), F.col("dimensions"), F.col("ts")).alias("new"))
)
query(
    "events_upsert",
    """WITH b AS (SELECT CAST(event_id AS VARCHAR) AS event_id, 'Seen ' || event_type AS title, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events),
u AS (SELECT CAST(3 * event_id AS VARCHAR) AS event_id, 'Changed' AS title, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id % 2 = 0 AS upsert FROM events)
SELECT event_id, coalesce(u.title, b.title) AS title, coalesce(b.ts, u.ts) AS ts FROM b FULL JOIN u USING (event_id) WHERE b.ts IS NOT NULL OR u.upsert""",
)(lambda s, d: upserted(s, d).select("event_id", "title", "ts"))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_events = tables.operational(spark, sf_dir)
    number = F.col("event_id").cast("bigint")
    changes = all_events.withColumns({"title": F.lit("Changed"), "seq": number, "upsert": number % 2 == 0, "event_id": (number * 3).cast("string")})
    return events.updated(all_events, changes)


NEW_ID = "strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') || '_' || md5(namespace || '|web|' || CASE WHEN d_user IS NULL THEN '{}' ELSE '{\"kind\":\"' || d_kind || '\",\"user\":\"' || d_user || '\"}' END || '|' || ts)"
query(
    "events_update_id",
    f"""WITH {EVENTS}, n AS (SELECT *, CAST(event_id AS BIGINT) AS i, {NEW_ID} AS new_id FROM ev)
SELECT event_id, CASE WHEN i % 4 = 0 THEN 'Changed' ELSE title END AS title, ts FROM n
UNION ALL SELECT DISTINCT new_id, 'Changed', ts FROM n WHERE i % 4 = 2""",
)(lambda s, d: updated_by_property(s, d).select("event_id", "title", "ts"))


def updated_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, of which each fourth has an update id of its own, each next one shares one with a hundred; updates for all of these ids and as many others."""
    number = F.col("event_id").cast("bigint")
    named = lambda column: F.create_map(F.lit("update_id"), column)
    base = tables.operational(spark, sf_dir)
    base = base.withColumn("additional_props", named(F.when(number % 4 == 0, F.concat(F.lit("u"), "event_id")).when(number % 4 == 1, F.concat(F.lit("d"), F.expr("CAST(event_id AS BIGINT) div 400")))))
    one = base.withColumns({"title": F.lit("Changed"), "seq": number, "upsert": number % 4 == 2, "additional_props": named(F.concat(F.lit("U"), "event_id"))})
    shared = one.withColumns({"additional_props": named(F.concat(F.lit("D"), F.expr("CAST(event_id AS BIGINT) div 400"))), "upsert": F.lit(False)})
    return events.updated_by_property(base, one.union(shared))


query("events_parent_child", f"WITH {EVENTS}, c AS (SELECT parent AS event_id, list_sort(list(DISTINCT event_id)) AS children FROM ev WHERE parent IS NOT NULL GROUP BY parent) SELECT event_id, coalesce(children, []) AS children FROM ev LEFT JOIN c USING (event_id)")(
    lambda s, d: events.with_children(tables.operational(s, d)).select("event_id", F.col("child_ids").alias("children"))
)
query("events_text", "SELECT conv_id || '-' || turn AS event_id FROM conversations WHERE contains(lower(text), 'con') AND contains(role, 'a') AND NOT contains(role, 'user')")(
    lambda s, d: events.searched(tables.spoken(s, d), 0, 2**40, "message:con AND role:a -namespace:user").select("event_id")
)


# Arrival

query("late_early", f"""WITH {USERS}, s AS (SELECT ts - ts % {SEGMENT} AS s, {START + 20 * DAY} AS hour FROM pts)
SELECT CASE WHEN (hour - s) // 3600 > 240 THEN 'late' WHEN s > hour THEN 'early' ELSE 'on_time' END AS status, count(*) AS points FROM s GROUP BY 1""")(
    lambda s, d: ingest.counted(users(s, d).points.df, ingest.arrival(F.lit(START + 20 * DAY), 10 * DAY))
)
query("ephemeral_arrival", f"""WITH {USERS}, s AS (SELECT ts - ts % {DAY} AS s, {START + 20 * DAY + 600} AS now FROM pts)
SELECT CASE WHEN now >= s + {DAY} + 900 THEN 'late' WHEN now < s - 30 THEN 'early' ELSE 'on_time' END AS status, count(*) AS points FROM s GROUP BY 1""")(
    lambda s, d: ingest.counted(users(s, d).points.df, ingest.ephemeral_arrival(F.lit(START + 20 * DAY + 600), DAY))
)
query(
    "admission",
    f"""WITH {USERS}, known AS (SELECT DISTINCT metric, "user" FROM pts WHERE ts < {START + DAY}),
later AS (SELECT metric, "user", min(ts) AS first FROM pts WHERE ts >= {START + DAY} GROUP BY ALL),
new AS (SELECT metric, "user", row_number() OVER (ORDER BY first, metric, "user") AS n FROM later ANTI JOIN known USING (metric, "user")),
passed AS (SELECT metric, "user" FROM known UNION ALL SELECT metric, "user" FROM new WHERE n <= 100)
SELECT metric, "user", ts, value, seq FROM pts JOIN passed USING (metric, "user") WHERE ts >= {START + DAY}""",
)(lambda s, d: admission(s, d).df)


def admission(spark: SparkSession, sf_dir: str) -> Points:
    """The series of the first day are known, a hundred more are let in."""
    points = tables.user_clicks(spark, sf_dir)
    known = meta.catalog(series.in_range(points, START, START + DAY))
    return ingest.admitted(series.in_range(points, START + DAY, END), known, known.count() + 100)


query("purge", f"WITH {USERS} SELECT * FROM pts WHERE ts - ts % {SEGMENT} + {SEGMENT} + 600 > {END - 5 * DAY}")(lambda s, d: ingest.purged(users(s, d).points, END, 5 * DAY).df)
query("idle_series", f"WITH {SERIES} SELECT metric, \"user\", k, last_ts FROM series WHERE last_ts < {END - 10 * DAY}")(
    lambda s, d: ingest.idle_series(meta.catalog(clicks(s, d).points), END, 10 * DAY).select("metric", "user", "k", "last_ts")
)
