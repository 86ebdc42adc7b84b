"""Keyed stateful operators with event-time timers.

Rows of a micro-batch reach a processor before the timers that fall due in it, and in no order. Each processor
therefore sorts its rows and looks first whether a deadline lies before the row at hand.

Every call on state or timers is a round trip to the JVM. So rows that wait are kept as JSON texts of many rows, and a batch
sets one timer a key, for the first row that falls due; it deals with all that are due and sets the next.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trackstream.functions.geo import EARTH_M
from trackstream.operators.motion import GAP_MS, MAX_KPH, OUT_OF_ORDER_MS, WINDOW_MS

#: Engine watermark delay: rows later than this are dropped by the engine (and counted in the query's progress).
HORIZON_MS = 3_600_000


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((math.radians(lon2) - math.radians(lon1)) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, a)))


def _round2(x: float | None) -> float | None:
    return None if x is None else math.floor(x * 100 + 0.5) / 100


def _shape(fields: str) -> Row:
    """A maker of rows with the names of a schema text."""
    return Row(*[f.split()[0] for f in fields.split(", ")])


#: Rows of one JSON text of a list state, at most.
PACKED = 2_000


def _packed(rows: list[tuple]) -> list[tuple[str]]:
    return [(json.dumps(rows[i : i + PACKED]),) for i in range(0, len(rows), PACKED)]


def _unpacked(state: Any) -> list[tuple]:
    return [tuple(row) for (text,) in state.get() for row in json.loads(text)]


def _keep(state: Any, rows: list[tuple]) -> None:
    """``rows`` as the whole content of a list state."""
    if rows:
        state.put(_packed(rows))
    else:
        state.clear()


def _in_event_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.event_ms, r.event_id))


class SpeedWindows(StatefulProcessor):
    """Tumbling windows that tell late samples instead of losing them.

    The engine's watermark lags by a wide horizon, so that late rows arrive here; the business watermark is ahead of it
    by the difference and decides what is late and when a window closes.
    """

    OUT = (
        "kind string, driver_id long, window_start long, window_end long, sample_count long, avg_speed_kph double, "
        "max_speed_kph double, distance_m double, event_id long, event_ms long"
    )

    def __init__(self, size_ms: int = WINDOW_MS, bound_ms: int = OUT_OF_ORDER_MS, horizon_ms: int = HORIZON_MS):
        self.row = _shape(self.OUT)
        self.size, self.bound, self.horizon = size_ms, bound_ms, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "rows string")

    def _business(self, timers: Any) -> float:
        now = timers.getCurrentWatermarkInMs()
        return now + self.horizon - self.bound - 1 if now > 0 else -math.inf

    def _wake(self, start: int) -> None:
        self.handle.registerTimer(start + self.size + self.bound - self.horizon)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        watermark, open_ = self._business(timerValues), []
        for r in _in_event_order(rows):
            start = r.event_ms - r.event_ms % self.size
            if start + self.size - 1 <= watermark:
                yield self.row("late", key[0], start, start + self.size, None, None, None, None, r.event_id, r.event_ms)
            else:
                open_.append((start, r.event_ms, r.event_id, r.latitude, r.longitude))
        if open_:
            self.samples.appendList(_packed(open_))
            self._wake(open_[0][0])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        closed = max(self._business(timerValues), expiredTimerInfo.getExpiryTimeInMs() + self.horizon - self.bound - 1)
        held = {row[:3]: row[3:] for row in _unpacked(self.samples)}  # a sample that came twice counts once
        windows: dict[int, list[tuple]] = {}
        for (start, *k), v in sorted(held.items()):
            if start + self.size - 1 <= closed:
                windows.setdefault(start, []).append((*k, *v))
        if not windows:
            return
        rest = sorted((*k, *v) for k, v in held.items() if k[0] not in windows)
        _keep(self.samples, rest)
        if rest:
            self._wake(rest[0][0])
        for start, samples in windows.items():
            yield self._window(key[0], start, samples)

    def _window(self, driver: int, start: int, samples: list[tuple]) -> Row:
        total = top = 0.0
        moved = 0
        for a, b in zip(samples, samples[1:], strict=False):
            m, ms = metres(*a[2:], *b[2:]), b[0] - a[0]
            total += m
            if ms > 0:
                moved += ms
                top = max(top, m / (ms / 1000.0) * 3.6)
        mean = total / (moved / 1000.0) * 3.6 if moved else 0.0
        return self.row("window", driver, start, start + self.size, len(samples), _round2(mean), _round2(top), _round2(total), None, None)


class DriverState(StatefulProcessor):
    """Snapshots after each sample, impossible-speed alerts, and gap alerts that also end the state.

    With ``gap_ms`` None there are no gap alerts, and the state of a driver ends ``ttl_ms`` of event time after its last
    sample, if that is given. A timer does this, as the engine's own time to live knows processing time only.
    """

    OUT = (
        "kind string, driver_id long, event_id long, event_ms long, lat double, lon double, prev_lat double, prev_lon double, "
        "reported_speed_kph double, derived_speed_kph double, heading int, vehicle_type string, trip_distance_m double, sample_count long"
    )

    def __init__(self, gap_ms: int | None = GAP_MS, max_kph: float = MAX_KPH, ttl_ms: int | None = None):
        self.row = _shape(self.OUT)
        self.gap, self.max_kph, self.ttl = gap_ms, max_kph, ttl_ms
        self.life = min((x for x in (gap_ms, ttl_ms) if x is not None), default=None)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = "event_ms long, lat double, lon double, speed double, heading int, metres double, n long"
        self.last = handle.getValueState("last", fields)

    def _last(self) -> tuple | None:
        last = self.last.get()
        return tuple(last) if last else None

    def _ended(self, key: Any, last_ms: int) -> Iterator[Row]:
        if self.life == self.gap:
            yield self.row("GPS_GAP", key[0], None, last_ms + self.gap, *[None] * 10)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = before = self._last()
        if before and self.life is not None:
            self.handle.deleteTimer(before[0] + self.life + 1)
        for r in _in_event_order(rows):
            if last and self.life is not None and r.event_ms - last[0] > self.life:  # its timer has not fired yet
                yield from self._ended(key, last[0])
                last = None
            kph, m = None, 0.0
            if last:
                m, ms = metres(last[1], last[2], r.latitude, r.longitude), r.event_ms - last[0]
                kph = m / (ms / 1000.0) * 3.6 if ms > 0 else None
                if kph is not None and kph > self.max_kph:
                    yield self.row("IMPOSSIBLE_SPEED", key[0], None, r.event_ms, None, None, None, None, None, _round2(kph), *[None] * 4)
            was = last or (None, None, None, None, None, 0.0, 0)
            speed = was[3] if r.speed_kph is None else r.speed_kph
            heading = was[4] if r.heading_degrees is None else r.heading_degrees
            last = (r.event_ms, r.latitude, r.longitude, speed, heading, was[5] + m, was[6] + 1)
            yield self.row("snapshot", key[0], r.event_id, r.event_ms, r.latitude, r.longitude, was[1], was[2], speed, _round2(kph), heading, r.vehicle_type, _round2(last[5]), last[6])
        if last:
            self.last.update(last)
            if self.life is not None:
                self.handle.registerTimer(last[0] + self.life + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last = self._last()
        if last:
            yield from self._ended(key, last[0])
            self.last.clear()


class FenceTransitions(StatefulProcessor):
    """ENTER and EXIT by driver and fence from rows that carry the ids of the fences they are in."""

    OUT = "driver_id long, fence_id long, transition string, lat double, lon double, event_ms long"

    def __init__(self):
        self.row = _shape(self.OUT)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inside = handle.getValueState("inside", "fence_ids string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        told = self.inside.get()
        held = before = set(json.loads(told[0])) if told else set()
        for r in _in_event_order(rows):
            now = set(r.fence_ids)
            for fence in sorted(held - now):
                yield self.row(key[0], fence, "EXIT", r.latitude, r.longitude, r.event_ms)
            for fence in sorted(now - held):
                yield self.row(key[0], fence, "ENTER", r.latitude, r.longitude, r.event_ms)
            held = now
        if held != before:
            self.inside.update((json.dumps(sorted(held)),))


def inside(lat: float, lon: float, edges: list[dict]) -> bool:
    """The test of ``geo.INSIDE`` for one point."""
    odd = False
    for e in edges:
        x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
        if (x2 - x1) * (lat - y1) == (y2 - y1) * (lon - x1) and min(x1, x2) <= lon <= max(x1, x2) and min(y1, y2) <= lat <= max(y1, y2):
            return False
        odd ^= (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
    return odd


class FenceChanges(StatefulProcessor):
    """ENTER and EXIT while fences are defined anew: a shard holds some drivers and the versions of all fences.

    Samples wait until the watermark, which follows the slower of samples and definitions, has passed them, and are held
    against the versions valid at their time. A new version keeps who was inside; the next sample tells whether that changed.
    Versions that no later sample can need are dropped.
    """

    OUT = FenceTransitions.OUT

    def __init__(self):
        self.row = _shape(self.OUT)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fences = handle.getMapState("fences", "fence_id long, valid_from long", "edges string")
        self.waiting = handle.getListState("waiting", "rows string")
        self.held = handle.getListState("held", "rows string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh = []
        for r in rows:
            if r.fence_id is not None:
                self.fences.updateValue((r.fence_id, r.valid_from), (r.edges,))
            else:
                fresh.append((r.event_ms, r.event_id, r.driver_id, r.latitude, r.longitude))
        if fresh:
            self.waiting.appendList(_packed(fresh))
            self.handle.registerTimer(min(fresh)[0])
        return iter(())

    def _versions(self) -> dict[int, list[tuple[int, list[dict]]]]:
        told: dict[int, list[tuple[int, list[dict]]]] = {}
        for (fence, start), (edges,) in self.fences.iterator():
            told.setdefault(fence, []).append((start, json.loads(edges)))
        return {fence: sorted(v, key=lambda x: x[0]) for fence, v in told.items()}

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = {row[:3]: row[3:] for row in _unpacked(self.waiting)}  # a sample that came twice counts once
        due = sorted(x for x in waiting.items() if x[0][0] <= now)
        if not due:
            return
        rest = [(*k, *v) for k, v in waiting.items() if k[0] > now]
        _keep(self.waiting, rest)
        if rest:
            self.handle.registerTimer(min(rest)[0])
        versions, held = self._versions(), {}
        for driver, fence in _unpacked(self.held):
            held.setdefault(driver, set()).add(fence)
        for (ms, event, driver), (lat, lon) in due:
            at = {fence: edges for fence, told in versions.items() for start, edges in told if start <= ms}  # the last one stays
            here, before = {fence for fence, edges in at.items() if inside(lat, lon, edges)}, held.get(driver, set())
            for fence in sorted(before - here):
                yield self.row(driver, fence, "EXIT", lat, lon, ms)
            for fence in sorted(here - before):
                yield self.row(driver, fence, "ENTER", lat, lon, ms)
            held[driver] = here
        _keep(self.held, [(driver, fence) for driver, fences in held.items() for fence in sorted(fences)])
        for fence, told in versions.items():
            for start in [start for start, _ in told if start <= now][:-1]:
                self.fences.removeKey((fence, start))


class ChangeLog(StatefulProcessor):
    """Changes of a row (table, key) put into the order of their log positions, each once.

    A change waits, by log position, until the watermark has passed its time and that of all before it: nothing earlier can
    come any more. Then it is told as an upsert or a delete, and as a step of the row's history: ``entered`` for the new
    status, ``left`` for the one before with the time spent in it. A position at or below the last one told, or one that
    waits already, is a replay and is dropped. ``regression`` tells at once that a change came after one of no lower position.
    """

    OUT = "kind string, table string, key string, lsn long, status string, ts_ms long, in_status_ms long, image string, prev_lsn long, offset long"

    def __init__(self):
        self.row = _shape(self.OUT)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.done = handle, None
        self.waiting = handle.getMapState("waiting", "lsn long", "op string, status string, ts_ms long, image string, offset long")
        self.told = handle.getValueState("told", "lsn long")
        self.step = handle.getValueState("step", "lsn long, status string, ts_ms long")
        self.came = handle.getValueState("came", "lsn long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        told = self.told.get()[0] if self.told.exists() else None
        came, due = (self.came.get()[0] if self.came.exists() else None), set()
        for r in sorted(rows, key=lambda r: (r.offset, r.lsn)):
            if came is not None and r.lsn <= came:
                yield self.row("regression", *key, r.lsn, None, None, None, None, came, r.offset)
            came = r.lsn
            if (told is None or r.lsn > told) and not self.waiting.containsKey((r.lsn,)):
                self.waiting.updateValue((r.lsn,), (r.op, r.status, r.event_ms, r.image, r.offset))
                due.add(r.event_ms)
        if came is not None:
            self.came.update((came,))
        for t in due:
            self.handle.registerTimer(t)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.done == (tuple(key), now):  # the first timer of a key that fires in a batch does the work of all
            return
        self.done, step = (tuple(key), now), (tuple(self.step.get()) if self.step.exists() else None)
        for (lsn,), (op, status, ts, image, offset) in sorted((tuple(k), tuple(v)) for k, v in list(self.waiting.iterator())):
            if ts > now:  # what comes before in the log goes first
                break
            self.waiting.removeKey((lsn,))
            self.told.update((lsn,))
            yield self.row("delete" if op == "DELETE" else "upsert", *key, lsn, status, ts, None, image, None, offset)
            if op != "DELETE":
                if step:
                    yield self.row("left", *key, step[0], step[1], step[2], ts - step[2], None, None, offset)
                step = (lsn, status, ts)
                self.step.update(step)
                yield self.row("entered", *key, lsn, status, ts, None, None, None, offset)


class LatestOf(StatefulProcessor):
    """Samples with the latest value of each column from other streams of the driver, at or before them in event time.

    Rows of all streams wait until the watermark, which follows the slowest stream, has passed them; at equal times a value
    comes before a sample. So a value that arrives after a later sample still counts.
    """

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.out = "driver_id long, event_ms long, event_id long, " + ", ".join(f"{c} string" for c in columns)
        self.row = _shape(self.out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.values = handle.getValueState("values", "named string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        fresh = [(r.event_ms, int(r.name is None), r.name or "", r.order or "", r.event_id if r.name is None else 0, r.value) for r in rows]
        self.waiting.appendList(_packed(fresh))
        self.handle.registerTimer(min(r[0] for r in fresh))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = {row[:5]: row[5] for row in _unpacked(self.waiting)}  # a row that came twice counts once
        due = sorted(k for k in waiting if k[0] <= now)
        if not due:
            return
        rest = [(*k, v) for k, v in waiting.items() if k[0] > now]
        _keep(self.waiting, rest)
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest))
        told = self.values.get()
        values = json.loads(told[0]) if told else {}
        before = dict(values)
        for k in due:
            if k[1]:
                yield self.row(key[0], k[0], k[4], *[values.get(c) for c in self.columns])
            elif waiting[k] is not None:
                values[k[2]] = waiting[k]
        if values != before:
            self.values.update((json.dumps(values),))
