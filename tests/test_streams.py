"""Registered streams on rows that the given tables hold too few of."""

from types import SimpleNamespace

from pyspark.sql import Row

from tests.conftest import SF
from trackstream import schemas
from trackstream.operators import geofence
from trackstream.operators.manifests import KeyedTable, Published
from trackstream.sources import tables as t
from trackstream.streaming import jobs, processors, twins


def test_a_sample_at_the_end_of_the_gap_starts_a_session(spark):
    for chunks in ((0, 0, 0), (0, 1, 2)):
        rows = [(chunks[0], 1, 1_000_000), (chunks[1], 1, 1_120_000), (chunks[2], 1, 1_239_999), (9, -1, 9_000_000)]
        replayed = jobs.replay(spark.createDataFrame(rows, "chunk int, driver_id long, event_ms long"), "chunk")
        with jobs.stateful(spark, replayed.rows):
            told = jobs.drained(jobs.sessions(replayed.stream)).where("driver_id = 1").collect()
        assert sorted((r.start_ms, r.end_ms, r.samples) for r in told) == [(1_000_000, 1_000_000, 1), (1_120_000, 1_239_999, 2)]


def test_first_of_a_topic_wins_though_it_arrives_later(spark, monkeypatch):
    late, soon = t.EPOCH_MS + 1_200_000, t.EPOCH_MS + 10
    rows = [(3, 7, t.EPOCH_MS, 40.0, 44.0, None, None, "CAR", late), (900, 7, t.EPOCH_MS, 40.0, 44.0, None, None, "CAR", soon)]
    monkeypatch.setattr(twins, "_valid", lambda s, d: s.createDataFrame(rows, schemas.LOCATION + ", arrival_ms long"))
    assert [tuple(r) for r in twins.stream_sink(spark, SF).collect()] == [(7, t.EPOCH_MS, 3)]


class Counted:
    """States and timers of one key that count the calls on them."""

    def __init__(self):
        self.calls, self.rows, self.timers = 0, [], set()

    def getListState(self, *_):
        return self

    getValueState = getMapState = getListState

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + rows

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, rows

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def clear(self):
        self.calls, self.rows = self.calls + 1, []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def __getattr__(self, name):
        def call(*_):
            self.calls += 1

        return call


def test_state_calls_do_not_grow_with_the_rows_of_a_key():
    at, handle, processor = t.EPOCH_MS, Counted(), processors.SpeedWindows(horizon_ms=60_000)
    processor.init(handle)
    rows = [Row(event_id=i, event_ms=at + i * 1_000, latitude=40.0 + i / 1e5, longitude=44.0) for i in range(300)]
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    assert list(processor.handleInputRows((7,), iter(rows + rows[:9]), now)) == []
    later, due = SimpleNamespace(getCurrentWatermarkInMs=lambda: at + 130_000), SimpleNamespace(getExpiryTimeInMs=lambda: min(handle.timers))
    told = list(processor.handleExpiredTimer((7,), later, due))
    assert [(r.window_start - at, r.sample_count) for r in told] == [(k * 60_000, 60) for k in range(len(told))] and len(told) == 3
    assert handle.calls <= 6


def test_pickups_are_met_without_python(spark):
    rows = [(1, "DRIVER_ASSIGNED", 0), (1, "PICKED_UP", 600), (2, "DRIVER_ASSIGNED", 0), (2, "PICKED_UP", 601), (3, "DRIVER_ASSIGNED", 5), (-1, "END", 9_000_000)]
    events = spark.createDataFrame([(k, 70 + k, kind, t.EPOCH_MS + ms, int(ms > 1_000)) for k, kind, ms in rows], "order_id long, driver_id long, kind string, event_ms long, chunk int")
    replayed = jobs.replay(events, "chunk")
    with jobs.stateful(spark, replayed.rows):
        late = jobs.pickup_timeouts(replayed.stream, 600)
        assert "TransformWithState" not in late._jdf.queryExecution().logical().toString()
        assert sorted((r.order_id, r.driver_id, r.event_ms - t.EPOCH_MS) for r in jobs.drained(late).collect()) == [(2, 72, 600), (3, 73, 605)]


def test_regressions_over_batches_and_retries(spark, tmp_path):
    last, told = KeyedTable(spark, f"{tmp_path}/last", ["table", "key"], ["offset"]), Published(spark, f"{tmp_path}/told")
    batches = [[("o", "1", 5, 0), ("o", "1", 4, 1), ("o", "2", 1, 2)], [("o", "1", 4, 3), ("o", "2", 2, 4)], [("o", "1", 6, 5), ("o", "2", 2, 6)]]
    for number, rows in enumerate(batches):
        for _ in range(2):
            jobs.regressions(spark.createDataFrame(rows, "table string, key string, lsn long, offset long"), last, told, number)
    assert sorted(tuple(r) for r in told.read("regressions").collect()) == [("1", 4, 4, 3), ("1", 4, 5, 1), ("2", 2, 2, 6)]


def test_many_fences_of_few_shapes_are_met_by_shape(spark):
    boxes = [(0.001, 0.002), (0.05, 0.04), (3.0, 2.0)]
    fences = [(i, f"f{i}", "ZONE", "POLYGON((" + ", ".join(f"{10 + x} {20 + y}" for x, y in ((0, 0), (w, 0), (w, h), (0, h), (0, 0))) + "))") for i in range(60) for w, h in [boxes[i % 3]]]
    table = spark.createDataFrame(fences, schemas.FENCE)
    points = spark.createDataFrame([(k, 20 + y, 10 + x) for k, (x, y) in enumerate([(0.0005, 0.001), (0.02, 0.01), (2.9, 1.9), (3.5, 1.0)])], "k int, latitude double, longitude double")
    assert geofence._spread(geofence._shaped(geofence.split_fences(table)[0])).select("_shape").distinct().count() == 3
    want = sorted((r.k, r.fence_id) for r in geofence.membership(points, table).collect())
    assert len(want) == 60 + 40 + 20
    for limit in (1, 20):
        assert sorted((r.k, r.fence_id) for r in geofence.membership(points, table, limit).collect()) == want
