"""Single operators on literal rows."""

import base64
import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from trackstream import schemas
from trackstream.functions import geo, ids
from trackstream.operators import cdc, geofence, ingest, motion, orders, serving, sinks
from trackstream.sources import tables, topics
from trackstream.sources.scratch import scratch
from trackstream.streaming import jobs, processors

T0 = 1_800_000_000_000


def samples(spark, rows):
    """(driver, lat, lon, event_ms[, speed, heading]) in arrival order."""
    full = [(i, r[0], r[3], r[1], r[2], *(r[4:] if len(r) > 4 else (None, None)), "CAR", r[3]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schemas.LOCATION + ", arrival_ms long")


def test_first_and_second_sample(spark):
    got = motion.snapshots(samples(spark, [(7, 40.1776, 44.5126, T0), (7, 40.1872, 44.5153, T0 + 60_000)]), T0).orderBy("event_ms").collect()
    assert got[0].sample_count == 1 and got[0].derived_speed_kph is None and got[0].trip_distance_m == 0 and got[0].prev_lat is None
    assert got[1].sample_count == 2 and 50 < got[1].derived_speed_kph < 80 and 900 < got[1].trip_distance_m < 1300
    assert got[1].prev_lat == 40.1776 and got[1].processing_lag_ms == 0


def test_drivers_are_apart_and_state_expires(spark):
    got = motion.snapshots(samples(spark, [(1, 40.1, 44.5, T0), (2, 40.2, 44.55, T0), (1, 40.11, 44.5, T0 + 1000), (1, 40.2, 44.5, T0 + 121_000)]), T0)
    assert {(r.driver_id, r.event_ms - T0): r.sample_count for r in got.collect()} == {(1, 0): 1, (1, 1000): 2, (2, 0): 1, (1, 121_000): 3}
    later = motion.snapshots(samples(spark, [(1, 40.1, 44.5, T0), (1, 40.11, 44.5, T0 + 120_001)]), T0)
    assert {r.sample_count for r in later.collect()} == {1}


@pytest.mark.parametrize(("lat", "lon", "ms", "alerts"), [(40.1786, 44.5126, 20_000, 0), (40.3, 44.7, 5_000, 1), (40.3, 44.7, 0, 0)])
def test_impossible_speed(spark, lat, lon, ms, alerts):
    assert motion.impossible_speeds(samples(spark, [(7, 40.1776, 44.5126, T0), (7, lat, lon, T0 + ms)])).count() == alerts


def test_gap_at_the_end_of_input(spark):
    (gap,) = motion.gps_gaps(samples(spark, [(7, 40.1776, 44.5126, T0)])).collect()
    assert gap.event_ms == T0 + 120_000 and gap.alert_id == f"GPS_GAP:7:{T0 + 120_000}" and gap.detail == "no GPS sample for 120s (event time)"


def test_window_takes_samples_out_of_order(spark):
    lats = [(40.1776, 0), (40.1781, 4000), (40.1779, 2000), (40.1783, 6000), (40.1786, 8000)]
    (w,) = motion.speed_windows(samples(spark, [(7, lat, 44.5126, T0 + ms) for lat, ms in lats])).collect()
    assert w.sample_count == 5 and 90 < w.distance_m < 140 and 20 < w.avg_speed_kph < 90 and w.max_speed_kph >= w.avg_speed_kph


def test_windows_adjoin_and_one_sample_is_zero(spark):
    got = motion.speed_windows(samples(spark, [(7, 40.17, 44.5, T0 + s * 1000) for s in (10, 40, 70, 100)])).collect()
    assert sorted((w.window_start - T0, w.sample_count) for w in got) == [(0, 2), (60_000, 2)]
    (one,) = motion.speed_windows(samples(spark, [(7, 40.17, 44.5, T0)])).collect()
    assert (one.avg_speed_kph, one.max_speed_kph, one.distance_m) == (0, 0, 0)


def test_late_sample_is_told(spark):
    rows = samples(spark, [(7, 40.17, 44.5, T0 + s * 1000) for s in (5, 10, 70, 30)]).withColumn("arrival_ms", F.col("event_id") + T0)
    got = motion.with_lateness(rows)
    assert [r.event_ms - T0 for r in got.where("late").collect()] == [30_000]
    assert motion.with_lateness(rows.limit(0)).count() == 0


def test_fence_crossings(spark):
    path = [(7, 40.19, 44.5133, T0), (7, 40.1776, 44.5133, T0 + 1000), (7, 40.1777, 44.5134, T0 + 2000), (7, 40.19, 44.5133, T0 + 3000)]
    fence = tables.fences(spark).where("id = 1")
    got = geofence.transitions(samples(spark, path), fence).orderBy("event_ms").collect()
    assert [(e.transition, e.event_ms - T0) for e in got] == [("ENTER", 1000), ("EXIT", 3000)] and len(got[0].event_id) == 24
    both = geofence.transitions(samples(spark, [(1, 40.1776, 44.5133, T0), (2, 40.19, 44.5133, T0)]), fence)
    assert [e.driver_id for e in both.collect()] == [1]


SHAPES = [
    (1, "concave", "ZONE", "POLYGON((0 0, 4 0, 4 4, 2 1, 0 4, 0 0))"),
    (2, "holed", "ZONE", "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"),
    (3, "bad", "ZONE", "not wkt"),
    (4, "open", "ZONE", "POLYGON((0 0, 1 0, 1 1))"),
    (5, "null", "ZONE", None),
]
POINTS = [(1, 3.0, 2.0), (2, 0.5, 2.0), (3, 5.0, 5.0), (4, 3.0, 3.0), (5, 0.0, 2.0), (6, 0.0, 0.0), (7, 4.0, 5.0), (8, 5.0, 4.0)]


@pytest.mark.parametrize("limit", [100, 0])
def test_polygons_with_holes_edges_and_bad_text(spark, limit):
    fences = spark.createDataFrame(SHAPES, schemas.FENCE)
    usable, rejected = geofence.split_fences(fences)
    assert sorted(r.id for r in usable.collect()) == [1, 2] and sorted(r.id for r in rejected.collect()) == [3, 4, 5]
    points = spark.createDataFrame(POINTS, "p long, latitude double, longitude double")
    got = {(r.p, r.fence_id) for r in geofence.membership(points, fences, limit).collect()}
    assert got == {(1, 2), (2, 1), (2, 2), (4, 2)}


def test_gate_reasons(spark):
    good = '{"event_id":1,"driver_id":7,"event_ms":1000,"latitude":%s,"longitude":44.5,"speed_kph":%s,"heading_degrees":%s}'
    values = [good % (40.17, "null", "null"), "\x00junk", None, good % (999, 1, 1), good % (40.17, -5, 1), good % (40.17, 401, 1), good % (40.17, 1, 360)]
    rows = [(v.encode() if v is not None else None, "t", 3, i, T0) for i, v in enumerate(values)]
    gated = ingest.gate(ingest.decode(spark.createDataFrame(rows, "value binary, topic string, partition int, offset long, timestamp long")))
    got = [r.reason for r in gated.orderBy("offset").collect()]
    assert got == [None, "decode-failure", "decode-failure", "coordinate out of range", "impossible speed", "impossible speed", "heading out of range"]
    assert ingest.valid(gated).count() == 1 and ingest.dead_letters(gated).count() == 6
    errors = [r.error for r in gated.orderBy("offset").collect()]
    assert errors[2] == "tombstone / null value" and errors[0] is None


def test_versions_together(spark):
    old = spark.createDataFrame([(1, 7, T0, 40.0, 44.0)], schemas.LOCATION_V1)
    new = spark.createDataFrame([(2, 7, T0, 40.0, 44.0, 5.0, 10, "CAR")], schemas.LOCATION)
    got = {r.event_id: r.vehicle_type for r in ingest.union_versions(old, new).collect()}
    assert got == {1: None, 2: "CAR"}


def test_insert_ignore_and_replacing(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0, "a"), (1, T0 + 1000, "b"), (2, T0, "c")], "driver_id long, event_ms long, v string")
    for _ in range(2):
        sinks.insert_ignore(rows, f"{tmp_path}/i", ["driver_id", "event_ms"], "event_ms")
    sinks.insert_ignore(rows.withColumn("v", F.lit("z")), f"{tmp_path}/i", ["driver_id", "event_ms"], "event_ms")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/i").collect()) == ["a", "b", "c"]
    events = spark.createDataFrame([("abc", T0, 1), ("abc", T0, 2), ("def", T0, 1)], "event_id string, event_ms long, ingested_at long")
    sinks.append_versions(events, f"{tmp_path}/r", "event_ms")
    got = serving.newest_version(spark.read.parquet(f"{tmp_path}/r"), "event_id", "ingested_at").collect()
    assert sorted((r.event_id, r.ingested_at) for r in got) == [("abc", 2), ("def", 1)]
    sinks.compact_versions(spark, f"{tmp_path}/r", f"{tmp_path}/c", "event_id", "ingested_at")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 2
    assert serving.raw_and_unique(events, "event_id").first() == (3, 2)


def test_state_never_goes_back(spark):
    def state(*rows):
        return spark.createDataFrame(list(rows), "k long, at long, v string")

    s = sinks.latest_state(None, state((1, 5, "new")), ["k"], ["at"])
    s = sinks.latest_state(s, state((1, 3, "stale"), (2, 1, "other")), ["k"], ["at"])
    assert {r.k: r.v for r in s.collect()} == {1: "new", 2: "other"}


ENVELOPES = [
    ("7", '{"before":{"id":7,"status":"CREATED"},"after":{"id":7,"status":"CONFIRMED"},"source":{"table":"orders","lsn":273827,"snapshot":"false"},"op":"u","ts_ms":1}', 1),
    ("8", '{"before":null,"after":{"id":8,"status":"CREATED"},"source":{"table":"orders","lsn":2,"snapshot":"last"},"op":"r","ts_ms":2}', 2),
    ("8", '{"before":{"id":8,"status":"CREATED"},"after":null,"source":{"table":"orders","lsn":3,"snapshot":"false"},"op":"d","ts_ms":3}', 3),
    ("8", None, 4),
    ("9", "not-json", 5),
    ("9", '{"op":"x","source":{"table":"orders","lsn":9},"ts_ms":9}', 6),
]


def test_envelopes(spark):
    rows = spark.createDataFrame([("fleet.public.orders", *e) for e in ENVELOPES], "topic string, key string, value string, offset long")
    got = cdc.normalise(rows).orderBy("offset").collect()
    assert [r.op for r in got] == ["UPDATE", "READ", "DELETE", "DELETE", None, "UNKNOWN"]
    assert got[0].lsn == 273827 and got[0].before.status == "CREATED" and got[0].after.status == "CONFIRMED"
    assert [r.from_snapshot for r in got] == [False, True, False, False, False, False]
    assert got[3].tombstone and got[3].before is None and got[4].error and got[5].lsn == 9
    assert cdc.current(cdc.changes(cdc.normalise(rows)).where("op <> 'UNKNOWN'")).select("id").collect() == [(7,)]
    assert rows.select(cdc.routed(F.col("topic"))).first()[0] == "fleet.orders.cdc"
    left = cdc.changes(cdc.normalise(rows)).withColumn("image", cdc.surviving()).where("offset = 3").first()
    assert left.image.status == "CREATED"


def test_order_total_and_rules(spark):
    items = spark.createDataFrame([(1, 1, 3, "1.50"), (1, 2, 2, "0.80"), (2, 1, 0, "1.00")], "order_id long, line int, quantity int, unit_price string")
    items = items.withColumn("unit_price", F.col("unit_price").cast("decimal(12,2)"))
    assert str(orders.order_totals(items).where("order_id = 1").first().total) == "6.10"
    assert orders.rule_violations(items, "order_id", {"quantity > 0": F.col("quantity") > 0}).collect() == [(2, "quantity > 0")]
    nested = orders.with_items(spark.createDataFrame([(1,), (3,)], "id long"), items)
    assert {r.id: len(r["items"]) for r in nested.collect()} == {1: 2, 3: 0}


def test_mean_speed(spark):
    rows = [(1, 0.0, 0.0, T0, float(v), 1) for v in (10, 20, 30)] + [(2, 0.0, 0.0, T0, None, 1), (2, 0.0, 0.0, T0, 40.0, 1)]
    got = {r.driver_id: (r.mean_speed_kph, r.processed) for r in motion.mean_speeds(samples(spark, rows)).collect()}
    assert got == {1: (20.0, 3), 2: (40.0, 2)}


def test_scalars(spark):
    row = spark.range(1).select(
        geo.haversine_m(*map(F.lit, (40.1776, 44.5126, 40.1872, 44.5153))).alias("m"),
        geo.bearing_deg(*map(F.lit, (0.0, 0.0, 0.0, 1.0))).alias("east"),
        geo.haversine_m(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("none"),
        geo.haversine_m(*map(F.lit, (0.0, 0.0, 0.0, 180.0))).alias("half"),
        geo.round2(F.lit(1.005)).alias("r"),
        geo.on_earth(F.lit(float("nan")), F.lit(1.0)).alias("nan"),
        ids.geofence_event_id(F.lit(7), F.lit(1), F.lit("ENTER"), F.lit(1800000001000)).alias("id"),
    ).first()
    assert 1050 < row.m < 1110 and row.east == pytest.approx(90) and row.none is None and row.half == pytest.approx(3.14159265 * 6371000, rel=1e-6)
    assert row.r == 1.0 and row.nan is False and len(row.id) == 24


def test_topic_frames_and_fence_files(spark, tmp_path):
    rows = spark.createDataFrame([(b"\x00\x00\x00\x00\x07abc",), (b"\x01junk!!",), (None,), (b"\x00",)], "value binary")
    assert [r.schema_id for r in topics.schema_id(rows).collect()] == [7, None, None, None]
    (tmp_path / "f.json").write_text('[{"id": 1, "name": "a", "type": "ZONE", "polygonWkt": "POLYGON((0 0, 1 0, 1 1, 0 0))"}, {"id": 2, "name": "b"}]')
    fences = topics.fences_json(spark, str(tmp_path / "f.json"))
    assert fences.columns == ["id", "name", "type", "polygonWkt"] and [r.id for r in geofence.split_fences(fences)[0].collect()] == [1]


def test_series_reads_touched_slices(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0), (1, T0 + 5 * sinks.DAY_MS)], "driver_id long, event_ms long")
    sinks.insert_ignore(rows, f"{tmp_path}/s", ["driver_id", "event_ms"], "event_ms")
    got = topics.series(spark, f"{tmp_path}/s", "event_ms", T0, T0 + 1, sinks.DAY_MS)
    assert got.count() == 1 and len(got.inputFiles()) >= 1


def test_ingest_counters(spark):
    gated = spark.createDataFrame([(None,), (None,), ("bad",)], "reason string")
    seen = Observation("ingest")
    gated.observe(seen, F.count_if(F.col("reason").isNull()).alias("valid")).count()
    assert seen.get == {"valid": 2} and ingest.observed(gated).count() == 3


def test_state_enriched_and_versions_as_of(spark):
    given = samples(spark, [(7, 40.0, 44.0, T0), (7, 40.0, 44.0, T0 + 10)])
    updates = spark.createDataFrame([(7, T0 + 5, "BUSY")], "driver_id long, event_ms long, shift string")
    got = {r.event_ms - T0: r["shift"] for r in motion.enrich_latest(given, updates, ["shift"]).collect()}
    assert got == {0: None, 10: "BUSY"}


def test_first_write_wins_by_order(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0, 3), (1, T0, 1), (1, T0, 2)], "driver_id long, event_ms long, event_id long")
    sinks.insert_ignore(rows, f"{tmp_path}/i", ["driver_id", "event_ms"], "event_ms", by=["event_id"])
    sinks.insert_ignore(rows.withColumn("event_id", F.lit(0).cast("long")), f"{tmp_path}/i", ["driver_id", "event_ms"], "event_ms")
    assert [r.event_id for r in spark.read.parquet(f"{tmp_path}/i").collect()] == [1]


def test_upsert_keeps_state_over_gaps(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(list(rows), "k long, at long")

    sinks.upsert_latest(batch((1, 5)), f"{tmp_path}/u", ["k"], ["at"], 2)
    last = sinks.upsert_latest(batch((2, 1)), f"{tmp_path}/u", ["k"], ["at"], 7)
    assert sorted(spark.read.parquet(last).collect()) == [(1, 5), (2, 1)]
    again = sinks.upsert_latest(batch((2, 1)), f"{tmp_path}/u", ["k"], ["at"], 7)
    assert sorted(spark.read.parquet(again).collect()) == [(1, 5), (2, 1)]
    with pytest.raises(ValueError, match="no state to start from"):
        sinks.upsert_latest(batch((9, 9)), f"{tmp_path}/u", ["k"], ["at"], 1)


def test_facts_read_only_their_dates(spark, tmp_path):
    facts = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("b", 1, 2)], "event_id string, v int, day int")
    for _ in range(2):
        sinks.merge_facts(facts, f"{tmp_path}/f", "event_id", "day", by=["v"])
    assert sorted(spark.read.parquet(f"{tmp_path}/f").select("event_id", "v", "day").collect()) == [("a", 1, 1), ("b", 1, 2)]


def test_alerts_with_and_without_ids(spark, tmp_path):
    alerts = spark.createDataFrame([("A:1:1", "A", None, 1, T0), ("B:2:1", "B", 2, None, T0)], "alert_id string, kind string, order_id long, driver_id long, event_ms long")
    for k in (1, 2):
        sinks.append_versions(alerts.withColumn("ingested_at", F.lit(k)), f"{tmp_path}/a", "event_ms", 30 * sinks.DAY_MS)
    got = serving.newest_version(spark.read.parquet(f"{tmp_path}/a"), "alert_id", "ingested_at").orderBy("alert_id").collect()
    assert [(r.order_id, r.driver_id, r.ingested_at) for r in got] == [(None, 1, 2), (2, None, 2)]


def test_database_table_there_and_back(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([(i, i * 0.5) for i in range(1200)], "id long, v double")
    sinks.to_jdbc(rows, url, "facts", **driver)
    got = topics.jdbc(spark, url, "facts", "ID", 0, 1200, 4, **driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in got.collect()) == [(i, i * 0.5) for i in range(1200)]


def test_framed_records_by_schema(spark):
    old = spark.createDataFrame([(1, 7, T0, 40.0, 44.0)], schemas.LOCATION_V1)
    new = spark.createDataFrame([(2, 7, T0, 40.0, 44.0, 5.0, 10, "CAR")], schemas.LOCATION)
    rows = topics.framed(old, 1).unionByName(topics.framed(new, 2)).unionByName(spark.createDataFrame([(b"\x00\x00\x00\x00\x02junk",), (b"bare",)], "value binary"))
    assert [r.record.event_id for r in topics.framed_rows(rows, schemas.LOCATION_V1, 1).collect()] == [1]
    assert [r.record.event_id if r.record else None for r in topics.framed_rows(rows, schemas.LOCATION, 2).collect()] == [2, None]


def test_long_bytes_are_cut(spark):
    rows = spark.createDataFrame([(b"\x01" * 1000, "t", 0, 1, T0)], "value binary, topic string, partition int, offset long, timestamp long")
    (r,) = ingest.decode(rows).collect()
    assert base64.b64decode(r.raw_base64) == b"\x01" * 256


def test_alert_texts(spark):
    (fast,) = motion.impossible_speeds(samples(spark, [(7, 40.1776, 44.5126, T0), (7, 40.3, 44.7, T0 + 5000)])).collect()
    assert re.fullmatch(r"\d+ km/h over 5\.0s between samples", fast.detail)
    (gap,) = motion.gps_gaps(samples(spark, [(7, 40.1776, 44.5126, T0)])).collect()
    assert gap.detail == "no GPS sample for 120s (event time)"


@pytest.mark.parametrize("bucket", [7, 1000, 10**9])
def test_spans_meet_events(spark, bucket):
    rng = random.Random(bucket)
    spans = [(i, rng.randrange(3), low, low + rng.randrange(-5, 60) if rng.random() < 0.9 else None) for i, low in enumerate(rng.randrange(200) for _ in range(60))]
    events = [(rng.randrange(3), rng.randrange(250)) for _ in range(120)]
    a, b = spark.createDataFrame(spans, "id int, k int, low long, high long"), spark.createDataFrame(events, "k int, at long")
    got = sorted((r.id, r["at"]) for r in orders.within(a, "low", "high", b, "at", ["k"], bucket).collect())
    assert got == sorted((i, t) for i, k, low, high in spans for j, t in events if j == k and high is not None and low <= t <= high)


def test_slices_follow_the_rows(spark):
    def slices(n, rows):
        given = samples(spark, [(7, 40.0, 44.0, T0 + (i % 10 if i % 2 else i * 50)) for i in range(n)])  # half of it in one burst
        return motion.arrival_slices(given, rows).groupBy("slice").count().collect()

    few, many = slices(400, 50), slices(1600, 50)
    assert len(few) >= 5 and len(many) >= 2 * len(few)
    order = motion.arrival_slices(samples(spark, [(7, 40.0, 44.0, T0 + i * i) for i in range(300)]), 20).orderBy("arrival_ms").collect()
    assert [r["slice"] for r in order] == sorted(r["slice"] for r in order)


def test_versions_of_a_busy_fence(spark):
    events = spark.createDataFrame([(i, 1 + (i > 90), T0 + i) for i in range(100)] + [(200, 9, T0)], "event_id long, fence_id long, event_ms long")
    versions = spark.createDataFrame([(1, T0, "a"), (1, T0 + 50, "b"), (2, T0 + 95, "c")], "fence_id long, valid_from long, name string")
    for limit in (100, 0):
        got = {r.event_id: r.name for r in geofence.as_of(events, versions, "fence_id", ["name"], limit).collect()}
        assert got == {i: ("b" if i >= 50 else "a") if i <= 90 else ("c" if i >= 95 else None) for i in range(100)} | {200: None}


def test_new_shape_of_a_fence_keeps_who_was_inside(spark):
    box = "POLYGON(({0} 0, {1} 0, {1} 9, {0} 9, {0} 0))"
    fences = spark.createDataFrame([(1, "f", "ZONE", box.format(0, 9), 0, T0 + 15), (1, "f", "ZONE", box.format(5, 9), T0 + 15, None)], schemas.FENCE + ", valid_from long, valid_to long")
    path = [(7, 4.0, 7.0, T0), (7, 4.0, 7.0, T0 + 20), (7, 4.0, 2.0, T0 + 30), (8, 4.0, 2.0, T0), (8, 4.0, 2.0, T0 + 20)]
    got = [(e.driver_id, e.transition, e.event_ms - T0) for e in geofence.transitions(samples(spark, path), fences).orderBy("driver_id", "event_ms").collect()]
    assert got == [(7, "ENTER", 0), (7, "EXIT", 30), (8, "ENTER", 0), (8, "EXIT", 20)]


def test_replay_writes_many_files_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(jobs, "FILE_ROWS", 300)
    rows = spark.range(3000).selectExpr("id", "id div 1000 as chunk")
    replayed = jobs.replay(rows, "chunk", spark.range(1).selectExpr("id"))
    assert (replayed.files, replayed.rows) == (4, 3000)
    seen = []
    query = replayed.stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(r.id // 1000 for r in b.collect()))).option("checkpointLocation", scratch(spark, "p")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [set(s) for s in seen] == [{0}, {1}, {2}, {0}] and [len(s) for s in seen] == [1000, 1000, 1000, 1]


def test_an_idle_source_holds_nothing_back(spark):
    with jobs.stateful(spark, 10, idle=True):
        assert spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "max"
    with jobs.stateful(spark, 10):
        assert spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "min"
    assert spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "min"


def test_change_log_in_any_order(spark):
    """Changes of one row in chunks out of log order, with replays: each told once, in order, and regressions as they come."""
    rows = [
        ("orders", "7", 3, "UPDATE", "READY", "c", T0 + 300, 30, 0), ("orders", "7", 1, "CREATE", "NEW", "a", T0 + 100, 31, 0), ("orders", "7", 3, "UPDATE", "READY", "c", T0 + 300, 32, 0),
        ("orders", "7", 2, "UPDATE", "SEEN", "b", T0 + 200, 33, 1), ("orders", "8", 9, "DELETE", "NEW", None, T0 + 50, 34, 1), ("orders", "7", 4, "DELETE", "READY", None, T0 + 400, 35, 1),
        ("", "", 0, None, None, None, T0 + 10_000_000, 36, 2),
    ]
    changes = spark.createDataFrame(rows, "table string, key string, lsn long, op string, status string, image string, event_ms long, offset long, chunk long")
    replayed = jobs.replay(changes, "chunk")
    with jobs.stateful(spark, replayed.rows):
        told = jobs.drained(jobs.change_log(replayed.stream, "1 hour")).where("key <> ''").collect()
    moves = sorted((r.key, r.lsn, r.kind, r.status, r.in_status_ms) for r in told if r.kind != "regression")
    assert moves == [
        ("7", 1, "entered", "NEW", None), ("7", 1, "left", "NEW", 100), ("7", 1, "upsert", "NEW", None),
        ("7", 2, "entered", "SEEN", None), ("7", 2, "left", "SEEN", 100), ("7", 2, "upsert", "SEEN", None),
        ("7", 3, "entered", "READY", None), ("7", 3, "upsert", "READY", None), ("7", 4, "delete", "READY", None), ("8", 9, "delete", "NEW", None),
    ]
    assert sorted((r.lsn, r.prev_lsn, r.offset) for r in told if r.kind == "regression") == [(1, 3, 31), (2, 3, 33)]


def test_point_test_of_streams_is_that_of_columns(spark):
    fences = geo.with_edges(spark.createDataFrame(SHAPES, schemas.FENCE)).where("edges is not null").collect()
    rng = random.Random(4)
    points = [(x, y) for _, x, y in POINTS] + [(rng.randrange(-2, 22) / 2, rng.randrange(-2, 22) / 2) for _ in range(200)]
    df = spark.createDataFrame([(f.id, x, y, f.edges, f.min_x, f.max_x, f.min_y, f.max_y) for f in fences for x, y in points], "id long, lat double, lon double, edges array<struct<x1:double,y1:double,x2:double,y2:double>>, min_x double, max_x double, min_y double, max_y double")
    for r in df.select("*", F.expr(geo.INSIDE).alias("within")).collect():
        assert processors.inside(r.lat, r.lon, [e.asDict() for e in r.edges]) == r.within
