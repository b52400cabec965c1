"""Stores, streams, planner choices and the entry module, where SQL has no say."""

from __future__ import annotations

import time

import pytest
from helpers import DATA, same_as_sql
from pyspark.sql import functions as F

import __spark_entry__
from tidegrid.functions.aggregates import ROLLUP, chain
from tidegrid.functions.filters import NOT, Chain, Explicit, Literal, Metric, fold
from tidegrid.functions.lossy import quantize
from tidegrid.model import Downsample, Points, Rate, Tags, seconds
from tidegrid.operators import events, groupby, rollup, series
from tidegrid.operators.rate import parted, rates
from tidegrid.plans import catalog, registry
from tidegrid.plans.query import Query, Store, chosen_rollup, planned
from tidegrid.sources import store, tables
from tidegrid.streaming import ingest

T0 = 1_704_067_200
TAGS = Tags({"host": "host"}, "rest")


def points(spark, n=240, step=60):
    rows = [("cpu.usr", f"h{h}", {"colo": f"c{h % 2}"}, T0 + k * step, float(k), k) for h in range(3) for k in range(n)]
    return Points(spark.createDataFrame(rows, "metric string, host string, rest map<string,string>, ts bigint, value double, seq bigint"), TAGS)


def test_points_come_back_pruned(spark, tmp_path):
    p = points(spark, 3000)
    store.write_points(p, str(tmp_path / "p"))
    got = store.read_points(spark, str(tmp_path / "p"), TAGS, T0, T0 + 3600)
    assert got.df.count() == 180
    assert "PartitionFilters: [isnotnull(day" in got.df._jdf.queryExecution().toString()


def test_flush_twice_leaves_one_copy(spark, tmp_path):
    p = points(spark)
    for _ in range(2):
        segment = store.flush(p, [str(tmp_path / "f")], T0 + 7300, 7200)
    assert segment == T0 and spark.read.parquet(str(tmp_path / "f")).count() == 360


def test_rollup_is_chosen_only_where_it_is_exact(spark):
    p = points(spark)
    s = Store(p, [(300, ROLLUP, rollup.rolled_up(series.deduped(p), 300))])
    end = T0 + 14400
    assert chosen_rollup(Query(None, T0, end, downsample=Downsample("avg", 600)), s)
    for spec in (Downsample("p99", 600), Downsample("avg", 60), Downsample("last", 600), Downsample("avg", 600, infectious=True)):
        assert not chosen_rollup(Query(None, T0, end, downsample=spec), s)
    assert not chosen_rollup(Query(None, T0, end, rate=Rate(), downsample=Downsample("avg", 600)), s)
    both = [planned(Query("cpu.usr", T0, end, downsample=Downsample("avg", 600), group_by=("colo",)), x) for x in (s, Store(p))]
    assert sorted(both[0].collect()) == sorted(both[1].collect()) and both[0].count() == 48


def test_stream_ingest_is_like_batch(spark, tmp_path):
    p = points(spark)
    p.df.write.parquet(str(tmp_path / "in"))
    source = p.on(spark.readStream.schema(p.df.schema).parquet(str(tmp_path / "in")))
    ingest.ingest(source, str(tmp_path / "out"), str(tmp_path / "ck"), lambda: T0 + 7200, 86400).trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    # Segments later than the current hour are early and dropped.
    assert stored.count() == p.df.where(ingest.arrival(F.lit(T0 + 7200), 86400) == "on_time").count() == 720


def test_live_last_values(spark, tmp_path):
    p = Points(points(spark).df.drop("rest"), Tags({"host": "host"}))
    p.df.write.parquet(str(tmp_path / "in"))
    source = p.on(spark.readStream.schema(p.df.schema).parquet(str(tmp_path / "in")))
    q = ingest.live_last_values(source, 3600).writeStream.outputMode("update").format("memory").queryName(f"live{int(time.time())}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.host, r.last_ts, r.last_value) for r in spark.table(q.name).where("not expired").collect()}
    assert {(f"h{h}", T0 + 239 * 60, 239.0) for h in range(3)} <= got


def test_rates_and_gaps_with_tags_in_a_map(spark):
    got = planned(Query("cpu.usr", T0, T0 + 7200, rate=Rate(60), downsample=Downsample("avg", 600, fill=True)), Store(points(spark, 60))).collect()
    assert len(got) == 36 and {r.value for r in got if r.bucket < T0 + 3600} == {1.0} and {r.value for r in got if r.bucket >= T0 + 3600} == {None}


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        return df._jdf.queryExecution().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")


def test_ranges_and_tags_reach_the_files(spark):
    small = str(DATA / "sf0.001")
    for name in ("raw_scan", "ds_avg", "rate", "stored_scan"):
        text = plan(catalog.QUERIES[name](spark, small))
        assert "GreaterThanOrEqual(ts," in text and "LessThan(ts," in text, name
    assert "PartitionFilters: [isnotnull(day" in plan(catalog.QUERIES["stored_scan"](spark, small))
    assert "EqualTo(metric,click)" in plan(catalog.QUERIES["stored_ds_avg"](spark, small))
    text = plan(catalog.QUERIES["events_time_range"](spark, small))
    assert "Or(Or(And(GreaterThanOrEqual(ts," in text and "EqualTo(ongoing,true)" in text
    text = plan(catalog.QUERIES["rollup_read_sum"](spark, small))
    assert "sum:double" in text.split("ReadSchema: ")[-1] and "min:double" not in text.split("ReadSchema: ")[-1] and "PartitionFilters: [isnotnull(day" in text
    text = plan(catalog.QUERIES["series_probe"](spark, small)).split("== Physical Plan ==")[-1]
    assert "day#" in text and " IN (" in text or "InSet" in text


def test_a_rate_moves_points_once(spark):
    text = plan(catalog.QUERIES["rate"](spark, str(DATA / "sf0.001"))).split("== Physical Plan ==")[-1]
    assert "Window [lag(value" in text
    assert all("ts#" not in line for line in text.splitlines() if "hashpartitioning(metric" in line)


def test_rates_take_as_many_partitions_as_the_input_is_large(spark, monkeypatch):
    """However many points Spark would put together, a task holds but a slice of them."""
    from tidegrid.operators import rate

    monkeypatch.setattr(rate, "SLICE", 5_000)
    assert rate.parted(tables.prices(spark, str(DATA / "sf0.001"))).df.rdd.getNumPartitions() > 20
    for name in ("rate_sales", "rate_to_count_inferred"):
        assert same_as_sql(spark, catalog.QUERIES[name], catalog.ORACLES[name], str(DATA / "sf0.001"))


def test_times_are_read_the_same_in_any_zone(spark):
    first = tables.clicks(spark, str(DATA / "sf0.001")).df.agg(F.min("ts")).first()[0]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert tables.clicks(spark, str(DATA / "sf0.001")).df.agg(F.min("ts")).first()[0] == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rates_over_parts_nulls_and_maps(spark):
    """A series with gaps of several days, one without a tag, and tags in a map; parts of an hour."""
    rows = [("m", h, {"c": "x"} if h else None, T0 + k * 1700 + (k // 7) * 90_000, float(k * k), k) for h in ("a", None) for k in range(40)]
    p = Points(spark.createDataFrame(rows, "metric string, host string, rest map<string,string>, ts bigint, value double, seq bigint"), TAGS)
    got = {(r.host, r.ts): r.value for r in rates(parted(p, 3600), Rate(1)).df.collect()}
    for h in ("a", None):
        mine = [(r[3], r[4]) for r in rows if r[1] == h]
        expected = [None] + [(b - a) / (t - s) for (s, a), (t, b) in zip(mine, mine[1:])]
        assert [got[h, t] for t, _ in mine] == pytest.approx(expected)


def streamed(spark, tmp_path, batches, run):
    """run(stream of points) over batches of rows in turn; what it gives out, in order."""
    schema = "metric string, host string, ts bigint, value double, seq bigint"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
        name = f"out{int(time.time() * 1000)}"
        source = Points(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), Tags({"host": "host"}))
        path = str(tmp_path / "out")

        def keep(df, number):
            df.write.mode("overwrite").parquet(f"{path}/batch={number}")

        df, mode = run(source)
        df.writeStream.outputMode(mode).queryName(name).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).orderBy("batch").collect()


def test_segment_rollups_are_like_those_of_a_batch(spark, tmp_path):
    rows = [("m", h, T0 + k * 60, float(k % 17), k) for h in ("a", "b") for k in range(240)]
    again = [("m", "a", T0 + 120, 99.0, 1000), ("m", "a", T0 + 180, 5.0, 1)]  # a second write, later and earlier
    late = [("m", "a", T0 + 10 * 7200, 1.0, 2000)]  # moves the watermark on
    got = streamed(spark, tmp_path, [rows + again, late], lambda p: (ingest.segment_rollups(p), "append"))
    batch = Points(spark.createDataFrame(rows + again, "metric string, host string, ts bigint, value double, seq bigint"), Tags({"host": "host"}))
    wanted = rollup.rolled_up(series.deduped(batch), 3600)
    totals = wanted.groupBy("metric", "host", "segment").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.max("max").alias("max"))
    assert {(r.host, r.segment, r.sum, r["count"], r.max) for r in got} == {(r.host, r.segment, r.sum, r["count"], r.max) for r in totals.collect()}


def test_last_values_keep_the_order_of_writes(spark, tmp_path):
    got = streamed(spark, tmp_path, [[("m", "a", T0, 1.0, 7), ("m", "a", T0, 2.0, 6)], [("m", "a", T0, 3.0, 5)], [("m", "a", T0, 4.0, 8)]], lambda p: (ingest.live_last_values(p, 3600), "update"))
    assert [r.last_value for r in got if not r.expired] == [1.0, 1.0, 4.0]


def test_ingest_tells_what_came_late(spark, tmp_path):
    now, told = T0 + 20 * 86400, []
    rows = [("m", "a", t, 1.0, k) for k, t in enumerate((now, now - 60, now - 15 * 86400, now + 86400))]
    spark.createDataFrame(rows, "metric string, host string, ts bigint, value double, seq bigint").write.parquet(str(tmp_path / "in"))
    source = Points(spark.readStream.schema("metric string, host string, ts bigint, value double, seq bigint").parquet(str(tmp_path / "in")), Tags({"host": "host"}))
    ingest.ingest(source, str(tmp_path / "out"), str(tmp_path / "ck"), lambda: now, 10 * 86400, told=lambda n, c: told.append((n, c))).trigger(availableNow=True).start().awaitTermination()
    assert told == [(0, {"on_time": 2, "late": 1, "early": 1})]


def test_routes():
    none = lambda: None
    r = registry.Registry()
    for s in (registry.Source("a", none, keeps=1000), registry.Source("b", none, keeps=1000), registry.Source("c", none, frozenset({"sys"}), tier=1), registry.Source("new", none, up_since=9_900, keeps=9_000)):
        r.register(s)
    asked = lambda q, now=10_000, **k: [(s.name, a, b) for s, a, b in r.route(q, now, **k)]
    assert asked(Query("sys.cpu", 9_500, 9_800)) == [("a", 9_500, 9_800)]
    assert asked(Query("sys.cpu", 100, 9_800)) == [("a", 9_000, 9_800), ("c", 100, 9_000)]
    assert asked(Query("sys.cpu", 9_600, 9_800, shift=500)) == [("a", 9_100, 9_300)]
    assert asked(Query("net.in", 100, 9_800), source="c") == [("c", 100, 9_800)]
    with pytest.raises(LookupError):
        asked(Query("net.in", 100, 9_800))
    r.register(registry.Source("a", none, keeps=1000, healthy=False))
    assert asked(Query("sys.cpu", 9_500, 9_800)) == [("b", 9_500, 9_800)]
    r.register(registry.Source("a", none, keeps=1000))
    r.mode = registry.ROUND_ROBIN
    assert [asked(Query("sys.cpu", 9_500, 9_800))[0][0] for _ in range(4)] == ["a", "b", "a", "b"]
    inner = Literal(None, "host", ("h",))
    assert registry.meta_request("ns", Explicit(None, inner), "m", 0, 1).where == Explicit(None, Chain(None, (Metric(None, ("m",)), inner)))
    assert registry.as_config(registry.meta_request("ns", None, "m", 0, 1, ["host"]), {"type": "MatchAll"})["group"] == ["host"]


def test_searches(spark):
    row = [("1", "web", "ns", "Deploy Started", "to host1 at 10:30 a/b", "p1", "ann", {"Host": "H1"}, {"k": "v:1"})]
    e = spark.createDataFrame(row, "event_id string, source string, namespace string, title string, message string, priority string, user_id string, dimensions map<string,string>, additional_props map<string,string>")
    hit = lambda q: e.where(events.matches(q)).count() == 1
    assert all(hit(q) for q in (None, "", "*:*", "deploy", "dep*", "d?ploy", '"deploy started"', "title:(nope started)", r"10\:30", "/host[0-9]$/", "Host:h1", "tag.Host:h1", "+ann -bob", "NOT bob", "ann && web", "bob || web", "ann^2 deploy~1", r"/A\/b/", "#x OR ann"))
    assert not any(hit(q) for q in ("bob", "-bob", "NOT ann", "(NOT bob)", '"started deploy"', "ann AND bob OR web", "+bob ann", "title:ann", r"\*eploy", "/^ost/"))
    for q in ("(a", "a)", '"a', "/a"):
        with pytest.raises(ValueError):
            events.matches(q)


def test_what_can_be_merged(spark):
    with pytest.raises(ValueError):
        groupby.merged([], ["metric"], "median")
    with pytest.raises(ValueError):
        groupby.partial(points(spark).df, TAGS, (), "p99")
    with pytest.raises(ValueError):
        fold(Explicit(NOT, Literal(None, "host", ("h",))), TAGS)


def test_a_hot_metric_is_several_files(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("'m' AS metric", "'h' AS host", "map('c', 'x') AS rest", f"{T0} + id % 80000 AS ts", "rand(1) AS value", "id AS seq")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        store.write_points(Points(rows, TAGS), str(tmp_path / "p"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "p").glob("day=*/*.parquet"))) > 1


def test_small_things(spark):
    assert [seconds(x) for x in ("30s", "5m", "2h", 7)] == [30, 300, 7200, 7]
    with pytest.raises(ValueError):
        chain(["avg", "avg"])
    value = spark.createDataFrame([(1.1,), (None,), (-2.5,)], "v double").select(quantize(F.col("v")).alias("v")).collect()
    assert abs(value[0].v - 1.1) < 1e-7 and value[1].v is None and value[2].v == -2.5
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
