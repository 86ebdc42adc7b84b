"""SQL that computes the registered queries' results independently, over the given tables (DuckDB dialect)."""

from __future__ import annotations

from trackstream.operators.cdc import EVENTS, NEXT_STATUS
from trackstream.sources.tables import EPOCH_MS, NOW_MS, PATH

_DIST = (
    "CASE WHEN ({a}) IS NOT NULL AND ({c}) IS NOT NULL THEN 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) "
    "+ cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))) END"
)


def dist(a: str, b: str, c: str, d: str) -> str:
    return _DIST.format(a=a, b=b, c=c, d=d)


def r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def r1(x: str) -> str:
    return f"round({x}, 1)"


LOC = f"""
b AS (SELECT event_id, user_id AS driver_id, value, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k,
        (epoch_us(ts) - 1704067200000000) // 1920000 AS e FROM events),
p AS (SELECT *, {EPOCH_MS} + e AS event_ms, 40 + (driver_id % 7) * 15 AS v FROM b),
loc AS (SELECT event_id, driver_id, event_ms,
    CASE WHEN event_id % 307 = 0 THEN 999.0::DOUBLE ELSE (40165000 + abs(((e * v) // 1000 + driver_id * 997) % 70000 - 35000)
        + CASE WHEN event_id % 211 = 0 THEN 500000 ELSE 0 END) / 1000000.0::DOUBLE END AS latitude,
    (44490000 + abs(((e * (v + 10)) // 1000 + driver_id * 1499) % 96000 - 48000)) / 1000000.0::DOUBLE AS longitude,
    CASE WHEN event_type = 'signup' THEN NULL WHEN event_id % 401 = 0 THEN -5.0 ELSE value END AS speed_kph,
    CAST((k * 37) // 10 AS INT) AS heading_degrees,
    CASE driver_id % 5 WHEN 0 THEN 'BICYCLE' WHEN 1 THEN 'SCOOTER' WHEN 2 THEN 'MOTORCYCLE' WHEN 3 THEN 'CAR' ELSE 'VAN' END AS vehicle_type,
    event_ms + (event_id * 7919) % 9000 + CASE WHEN event_id % 97 = 0 THEN 90000 ELSE 0 END AS arrival_ms,
    event_id % 503 = 0 AS undecodable FROM p),
gated AS (SELECT *, CASE WHEN undecodable THEN 'decode-failure'
    WHEN NOT (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) THEN 'coordinate out of range'
    WHEN speed_kph < 0 OR speed_kph > 400 THEN 'impossible speed'
    WHEN heading_degrees < 0 OR heading_degrees >= 360 THEN 'heading out of range' END AS reason FROM loc),
valid AS (SELECT * FROM gated WHERE reason IS NULL),
pairs AS (SELECT *, lag(latitude) OVER w AS prev_lat, lag(longitude) OVER w AS prev_lon, lag(event_ms) OVER w AS prev_ms
    FROM valid WINDOW w AS (PARTITION BY driver_id ORDER BY event_ms, event_id)),
legs AS (SELECT *, {dist('prev_lat', 'prev_lon', 'latitude', 'longitude')} AS leg_m, event_ms - prev_ms AS leg_ms,
    CASE WHEN event_ms - prev_ms > 0 THEN {dist('prev_lat', 'prev_lon', 'latitude', 'longitude')} / ((event_ms - prev_ms) / 1000.0) * 3.6 END AS leg_kph FROM pairs),
fences(fence_id, fence_name, fence_type, x1, y1, x2, y2) AS (VALUES
    (1::BIGINT, 'Republic Square pickup', 'RESTAURANT', 44.5126::DOUBLE, 40.1770::DOUBLE, 44.5140::DOUBLE, 40.1782::DOUBLE), (2, 'Opera pickup', 'RESTAURANT', 44.5146, 40.1866, 44.5160, 40.1878),
    (3, 'Cascade pickup', 'RESTAURANT', 44.5187, 40.1901, 44.5201, 40.1913), (4, 'Kentron delivery zone', 'ZONE', 44.4980, 40.1700, 44.5300, 40.1950)),
flags AS (SELECT v.*, f.*, longitude > x1 AND longitude < x2 AND latitude > y1 AND latitude < y2 AS inside FROM valid v, fences f),
moves AS (SELECT *, coalesce(lag(inside) OVER (PARTITION BY driver_id, fence_id ORDER BY event_ms, event_id), FALSE) AS was FROM flags),
fence_events AS (SELECT driver_id, fence_id, fence_name, fence_type, CASE WHEN inside THEN 'ENTER' ELSE 'EXIT' END AS transition,
    latitude AS lat, longitude AS lon, event_ms,
    substr(sha256(concat_ws('|', driver_id, fence_id, CASE WHEN inside THEN 'ENTER' ELSE 'EXIT' END, event_ms)), 1, 24) AS event_id
    FROM moves WHERE inside <> was),
dwell AS (SELECT driver_id, fence_id, event_ms AS enter_ms, lead(event_ms) OVER w AS exit_ms, transition, lead(transition) OVER w AS next
    FROM fence_events WINDOW w AS (PARTITION BY driver_id, fence_id ORDER BY event_ms, transition DESC))
"""


def windows(source: str, extra: str = "") -> str:
    """Tumbling one-minute speed windows over rows of ``source``."""
    return f"""
wp AS (SELECT *, event_ms - event_ms % 60000 AS window_start FROM {source} {extra}),
wl AS (SELECT *, lag(latitude) OVER w AS a, lag(longitude) OVER w AS b, event_ms - lag(event_ms) OVER w AS dt
    FROM wp WINDOW w AS (PARTITION BY driver_id, window_start ORDER BY event_ms, event_id)),
wd AS (SELECT *, {dist('a', 'b', 'latitude', 'longitude')} AS m FROM wl),
win AS (SELECT driver_id, window_start, window_start + 60000 AS window_end, count(*) AS sample_count,
    {r2('coalesce(coalesce(sum(m), 0) / (sum(CASE WHEN dt > 0 THEN dt END) / 1000.0) * 3.6, 0.0)')} AS avg_speed_kph,
    {r2('coalesce(max(CASE WHEN dt > 0 THEN m / (dt / 1000.0) * 3.6 END), 0.0)')} AS max_speed_kph,
    {r2('coalesce(sum(m), 0.0)')} AS distance_m FROM wd GROUP BY ALL)
"""


LATE = """
seen AS (SELECT *, max(event_ms) OVER (ORDER BY arrival_ms, event_id ROWS UNBOUNDED PRECEDING) AS top FROM valid),
judged AS (SELECT *, event_ms - event_ms % 60000 + 59999 <= top - 5001 AS late FROM seen)
"""
SESSIONS = """
gaps AS (SELECT *, CASE WHEN event_ms - lag(event_ms) OVER w > 120000 THEN 1 ELSE 0 END AS fresh FROM valid
    WINDOW w AS (PARTITION BY driver_id ORDER BY event_ms, event_id)),
sess AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY driver_id ORDER BY event_ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM gaps)
"""
_path = "[" + ", ".join(f"'{s}'" for s in PATH) + "]"
_legal = ", ".join(f"('{a}', '{b}')" for a, after in NEXT_STATUS.items() for b in after)
_named = ", ".join(f"('{s}', '{e}')" for (t, s), e in EVENTS.items() if t == "orders")
CDC = f"""
o AS (SELECT o_orderkey AS k, o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(12, 2)) AS total_amount, epoch_ms(o_orderdate) AS t0,
    CASE WHEN o_orderkey % 11 = 0 THEN 3 WHEN o_orderstatus = 'F' THEN 7 WHEN o_orderstatus = 'P' THEN 5 ELSE 2 END AS n FROM orders),
s AS (SELECT *, unnest(range(1, n + 1)) AS i FROM o),
steps AS (SELECT *, CASE WHEN k % 11 = 0 AND i = 3 THEN 'CANCELLED' ELSE {_path}[i] END AS status,
    k * 100 + i AS lsn, t0 + i * 300000 + CASE WHEN i >= 4 THEN (k % 7) * 60000 ELSE 0 END AS ts_ms
    FROM s WHERE NOT (k % 13 = 0 AND n >= 5 AND i = 3)),
trail AS (SELECT *, lag(status) OVER (PARTITION BY k ORDER BY i) AS before FROM steps),
ch AS (
    SELECT k, i, n, customer_id, total_amount, CASE WHEN i > 1 THEN 'UPDATE' WHEN k % 5 = 0 THEN 'READ' ELSE 'CREATE' END AS op, i = 1 AND k % 5 = 0 AS from_snapshot,
        lsn, ts_ms, before, status, k * 1000 + i * 2 AS off FROM trail
    UNION ALL
    SELECT k, i, n, customer_id, total_amount, CASE WHEN i > 1 THEN 'UPDATE' WHEN k % 5 = 0 THEN 'READ' ELSE 'CREATE' END, i = 1 AND k % 5 = 0, lsn, ts_ms, before, status, k * 1000 + i * 2 + 1
        FROM trail WHERE i = n AND k % 17 = 0
    UNION ALL
    SELECT k, i, n, customer_id, total_amount, 'DELETE', FALSE, k * 100 + 90, ts_ms, status, NULL, k * 1000 + 180 FROM trail WHERE i = n AND k % 19 = 0),
dedup AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY k, lsn ORDER BY off) = 1),
ord AS (SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(12, 2)) AS total_amount FROM orders),
items AS (SELECT l_orderkey AS order_id, l_linenumber AS line, CASE WHEN l_orderkey % 997 = 0 THEN 0 ELSE CAST(l_quantity AS INT) END AS quantity,
    CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS DECIMAL(12, 2)) AS unit_price FROM lineitem),
totals AS (SELECT order_id, CAST(sum(unit_price * quantity) AS DECIMAL(18, 2)) AS total, count(*) AS n_items FROM items GROUP BY 1),
d0 AS (SELECT o_orderkey, o_orderstatus, o_custkey % (SELECT count(DISTINCT user_id) FROM events) AS driver_id, o_orderkey % 3 AS r,
    {EPOCH_MS} + (o_orderkey * 90007) % 1200000 AS assigned_ms FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderstatus IN ('F', 'P')),
d1 AS (SELECT *, assigned_ms + 60000 + (o_orderkey % 23) * 45000 AS picked_up_ms FROM d0),
del AS (SELECT o_orderkey * 10 AS id, o_orderkey AS order_id, driver_id, r + 1 AS restaurant_id, assigned_ms, picked_up_ms,
    CASE WHEN o_orderstatus = 'F' THEN picked_up_ms + 120000 + (o_orderkey % 31) * 10000 END AS delivered_ms,
    ([40.1776, 40.1872, 40.1907]::DOUBLE[])[r + 1] AS pickup_lat, ([44.5133, 44.5153, 44.5194]::DOUBLE[])[r + 1] AS pickup_lon,
    (40170100 + (o_orderkey * 37) % 24800) / 1000000.0::DOUBLE AS delivery_lat, (44498100 + (o_orderkey * 53) % 31800) / 1000000.0::DOUBLE AS delivery_lon FROM d1),
dr AS (SELECT DISTINCT user_id AS driver_id FROM events),
shift AS (
    SELECT driver_id * 10 AS id, driver_id, CASE WHEN driver_id % 10 = 0 THEN 'ACTIVE' ELSE 'ENDED' END AS status, {EPOCH_MS} + (driver_id % 12) * 600000 AS started_ms,
        CASE WHEN driver_id % 10 <> 0 THEN {EPOCH_MS} + (driver_id % 12) * 600000 + 14400000 + (driver_id % 9) * 900000 END AS ended_ms FROM dr
    UNION ALL SELECT driver_id * 10 + 1, driver_id, 'ACTIVE', {EPOCH_MS} + 20000000, NULL FROM dr WHERE driver_id % 50 = 0)
"""


def loc(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([LOC, *ctes]) + body


def cdc(body: str) -> str:
    return "WITH " + CDC + body


def both(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([LOC, CDC, *ctes]) + body


_snap = "PARTITION BY driver_id, session ORDER BY event_ms, event_id"
_samples = "event_id, driver_id, event_ms, latitude, longitude, speed_kph, heading_degrees, vehicle_type"

_ALERTS = """SELECT concat_ws(':', 'IMPOSSIBLE_SPEED', driver_id, event_ms) AS alert_id, 'IMPOSSIBLE_SPEED' AS kind, NULL::BIGINT AS order_id, driver_id, event_ms FROM legs WHERE leg_kph > 150
    UNION ALL SELECT concat_ws(':', 'GPS_GAP', driver_id, event_ms + 120000), 'GPS_GAP', NULL, driver_id, event_ms + 120000
    FROM (SELECT *, lead(event_ms) OVER (PARTITION BY driver_id ORDER BY event_ms, event_id) AS nxt FROM valid) WHERE nxt IS NULL OR nxt - event_ms > 120000
    UNION ALL SELECT concat_ws(':', 'ORDER_PICKUP_TIMEOUT', order_id, assigned_ms + 600000), 'ORDER_PICKUP_TIMEOUT', order_id, NULL, assigned_ms + 600000 FROM del WHERE picked_up_ms IS NULL OR picked_up_ms - assigned_ms > 600000"""

SQL: dict[str, str] = {
    "ingest_validate": loc(f"SELECT {_samples}, arrival_ms FROM valid"),
    "dead_letters": loc(
        """SELECT event_id AS "offset", reason, CASE WHEN undecodable THEN '{"reason":"decode-failure","error":"not decodable","topic":"driver.location","partition":' || (driver_id % 24)
        || ',"offset":' || event_id || ',"rawBase64":"' || base64('\\x00\\xFF'::BLOB || event_id::VARCHAR::BLOB) || '"}' ELSE '{"reason":"' || reason || '"' END AS payload_start FROM gated WHERE reason IS NOT NULL"""
    ),
    "ingest_quality_counts": loc("SELECT coalesce(reason, 'valid') AS outcome, count(*) AS n FROM gated GROUP BY 1"),
    "ingest_quality_rate_1m": loc("SELECT arrival_ms - arrival_ms % 60000 AS minute_ms, reason IS NULL AS ok, count(*) / 60.0::DOUBLE AS per_second FROM gated GROUP BY 1, 2"),
    "strict_validity": loc(
        """SELECT event_id, latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND coalesce(speed_kph BETWEEN 0 AND 300, TRUE)
        AND coalesce(heading_degrees >= 0 AND heading_degrees < 360, TRUE) AS strictly_valid, speed_kph IS NOT NULL AND heading_degrees IS NOT NULL AS has_kinematics FROM loc WHERE NOT undecodable"""
    ),
    "schema_evolution_union": loc(
        """SELECT event_id, driver_id, event_ms, latitude, longitude, CASE WHEN event_id % 2 = 0 THEN speed_kph END AS speed_kph, CASE WHEN event_id % 2 = 0 THEN heading_degrees END AS heading_degrees,
        CASE WHEN event_id % 2 = 0 THEN vehicle_type END AS vehicle_type FROM valid"""
    ),
    "legs": loc(
        f"""SELECT event_id, driver_id, leg_ms, {r2('leg_m')} AS leg_m, {r2('leg_kph')} AS leg_kph FROM legs WHERE prev_ms IS NOT NULL"""
    ),
    "leg_bearings": loc(
        f"""SELECT event_id, {r1("fmod(degrees(atan2(sin(radians(longitude) - radians(prev_lon)) * cos(radians(latitude)), cos(radians(prev_lat)) * sin(radians(latitude)) - sin(radians(prev_lat)) * cos(radians(latitude)) * cos(radians(longitude) - radians(prev_lon)))) + 360.0, 360.0)")} AS bearing
        FROM legs WHERE prev_ms IS NOT NULL AND leg_m > 0"""
    ),
    "driver_sessions": loc("SELECT driver_id, session, min(event_ms) AS start_ms, max(event_ms) AS end_ms, count(*) AS samples FROM sess GROUP BY 1, 2", SESSIONS),
    "driver_snapshots": loc(
        f"""SELECT event_id, driver_id, latitude AS lat, longitude AS lon, a AS prev_lat, b AS prev_lon, last_value(speed_kph IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS reported_speed_kph,
        {r2('CASE WHEN dt > 0 THEN m / (dt / 1000.0) * 3.6 END')} AS derived_speed_kph, last_value(heading_degrees IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS heading, vehicle_type,
        {r2('sum(coalesce(m, 0)) OVER (w ROWS UNBOUNDED PRECEDING)')} AS trip_distance_m, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS sample_count, event_ms, greatest(0, {NOW_MS} - event_ms) AS processing_lag_ms
        FROM sd WINDOW w AS ({_snap})""",
        SESSIONS,
        f"sp AS (SELECT *, lag(latitude) OVER w AS a, lag(longitude) OVER w AS b, event_ms - lag(event_ms) OVER w AS dt FROM sess WINDOW w AS ({_snap}))",
        f"sd AS (SELECT *, {dist('a', 'b', 'latitude', 'longitude')} AS m FROM sp)",
    ),
    "impossible_speed_alerts": loc(
        f"""SELECT concat_ws(':', 'IMPOSSIBLE_SPEED', driver_id, event_ms) AS alert_id, 'IMPOSSIBLE_SPEED' AS kind, driver_id, event_ms, {r2('leg_kph')} AS leg_kph,
        CAST(floor(leg_kph + 0.5) AS BIGINT) || ' km/h over ' || ((leg_ms + 50) // 1000) || '.' || ((leg_ms + 50) // 100 % 10) || 's between samples' AS detail FROM legs WHERE leg_kph > 150"""
    ),
    "gps_gap_alerts": loc(
        """SELECT concat_ws(':', 'GPS_GAP', driver_id, event_ms + 120000) AS alert_id, 'GPS_GAP' AS kind, driver_id, event_ms + 120000 AS event_ms, 'no GPS sample for 120s (event time)' AS detail
        FROM (SELECT *, lead(event_ms) OVER (PARTITION BY driver_id ORDER BY event_ms, event_id) AS nxt FROM valid) WHERE nxt IS NULL OR nxt - event_ms > 120000"""
    ),
    "speed_window_1m": loc("SELECT * FROM win", windows("valid")),
    "speed_window_1m_late_split": loc("SELECT * FROM win", LATE, windows("judged", "WHERE NOT late")),
    "late_samples": loc("""SELECT event_id, '{"late":true,"driverId":' || driver_id || ',"eventTime":' || event_ms || '}' AS payload FROM judged WHERE late""", LATE),
    "speed_sliding_5m": loc(
        f"""SELECT driver_id, window_start, {r2('avg(leg_kph)')} AS avg_speed_kph, {r2('max(leg_kph)')} AS max_speed_kph, count(*) AS legs FROM
        (SELECT driver_id, leg_kph, unnest(range(event_ms - event_ms % 60000 - 240000, event_ms - event_ms % 60000 + 1, 60000)) AS window_start FROM legs WHERE leg_kph IS NOT NULL) GROUP BY 1, 2"""
    ),
    "active_drivers_30s": loc(
        """SELECT window_start, count(DISTINCT driver_id) AS drivers FROM
        (SELECT driver_id, unnest(range(event_ms - event_ms % 10000 - 20000, event_ms - event_ms % 10000 + 1, 10000)) AS window_start FROM valid) GROUP BY 1"""
    ),
    "driver_mean_speed": loc(f"SELECT driver_id, {r2('avg(speed_kph)')} AS mean_speed_kph, count(speed_kph) AS with_speed, count(*) AS processed FROM valid GROUP BY 1"),
    "geofence_membership": loc("SELECT event_id, fence_id, fence_name, fence_type FROM flags WHERE inside"),
    "geofence_lookup": loc("SELECT event_id, string_agg(fence_id::VARCHAR, ',' ORDER BY fence_id) AS fences FROM flags WHERE inside GROUP BY 1"),
    "geofence_events": loc("SELECT * FROM fence_events"),
    "geofence_dwell_p95": loc(
        f"""SELECT fence_id, enter_ms - enter_ms % 3600000 AS hour_ms, count(*) AS stays, {r2('quantile_cont(exit_ms - enter_ms, 0.95)')} AS p95_dwell_ms
        FROM dwell WHERE transition = 'ENTER' AND next = 'EXIT' GROUP BY 1, 2"""
    ),
    "geofence_versions": loc(
        """SELECT event_id, fence_id, event_ms, v AS version FROM (SELECT event_id, fence_id, event_ms, CASE WHEN event_ms >= 1704070800000 + fence_id * 60000 THEN 2 ELSE 1 END AS v FROM fence_events)"""
    ),
    "driver_current_state": loc("SELECT driver_id, event_id, event_ms, latitude, longitude, speed_kph FROM valid QUALIFY row_number() OVER (PARTITION BY driver_id ORDER BY event_ms DESC, event_id DESC) = 1"),
    "latest_positions_top10": loc(
        """SELECT driver_id, event_ms, latitude, longitude, floor(speed_kph * 10 + 0.5) / 10 AS speed_kph FROM valid QUALIFY row_number() OVER (PARTITION BY driver_id ORDER BY event_ms DESC, event_id DESC) = 1 ORDER BY driver_id LIMIT 10"""
    ),
    "events_dedup_final": loc("SELECT event_id, driver_id, fence_id, transition, event_ms, CASE WHEN event_ms % 3 = 0 THEN event_ms + 60000 ELSE event_ms + 1000 END AS ingested_at FROM fence_events"),
    "raw_vs_unique": loc("SELECT count(*) + count(*) FILTER (event_ms % 3 = 0) AS raw_rows, count(DISTINCT event_id) AS unique_ids FROM fence_events"),
    "distinct_keys": loc("SELECT count(*) AS n FROM (SELECT DISTINCT driver_id, event_ms FROM valid)"),
    "row_counts": loc(
        """SELECT 'driver_state' AS table_name, count(*) AS n FROM valid UNION ALL SELECT 'speed_windows', count(*) FROM win UNION ALL SELECT 'geofence_events', count(*) FROM fence_events""", windows("valid")
    ),
    "sink_insert_ignore_replay": loc("SELECT driver_id, event_ms, min(event_id) AS event_id FROM valid GROUP BY 1, 2"),
    "sink_replacing_replay": loc("SELECT event_id, transition, event_ms, CASE WHEN event_ms % 3 = 0 THEN event_ms + 60000 ELSE event_ms + 1000 END AS ingested_at FROM fence_events"),
    "latest_state_upsert": loc("SELECT driver_id, event_ms, event_id, latitude, longitude FROM valid QUALIFY row_number() OVER (PARTITION BY driver_id ORDER BY event_ms DESC, event_id DESC) = 1"),
    "fact_merge": cdc("SELECT order_id, restaurant_id, delivered_ms, (delivered_ms - delivered_ms % 86400000) AS day_ms FROM del WHERE delivered_ms IS NOT NULL"),
    "delivery_p95_rollup": cdc('SELECT restaurant_id, count(*) AS "values", TRUE AS within_bound FROM del WHERE delivered_ms IS NOT NULL GROUP BY 1'),
    "geofence_dwell_p95_rollup": loc("""SELECT fence_id, count(*) AS "values", TRUE AS within_bound FROM dwell WHERE transition = 'ENTER' AND next = 'EXIT' GROUP BY 1"""),
    "fact_merge_updates": cdc(
        """SELECT order_id, restaurant_id, known_ms, known_ms - known_ms % 86400000 AS day_ms FROM (SELECT order_id, restaurant_id,
        CASE WHEN delivered_ms IS NULL THEN picked_up_ms ELSE delivered_ms + CASE WHEN order_id % 11 = 3 THEN 259200000 ELSE 0 END END AS known_ms FROM del)"""
    ),
    "order_totals": cdc("SELECT * FROM totals"),
    "order_with_items": cdc(
        """SELECT id, ord.status, coalesce(string_agg(line || ':' || quantity || ':' || unit_price, ',' ORDER BY line, quantity, unit_price), '') AS items FROM ord LEFT JOIN items ON id = order_id GROUP BY ALL"""
    ),
    "order_total_mismatch": cdc("SELECT id, total_amount AS stored, total AS recomputed FROM ord JOIN totals ON id = order_id WHERE total_amount <> total"),
    "orders_by_status": cdc("SELECT id, customer_id, status FROM ord WHERE status = 'P'"),
    "drivers_by_status": cdc("SELECT id, driver_id, status FROM shift WHERE status = 'ACTIVE' ORDER BY id"),
    "dq_row_rules": cdc(
        """SELECT order_id AS key, 'quantity > 0' AS rule FROM items WHERE quantity <= 0 UNION ALL SELECT order_id, 'unit_price >= 0' FROM items WHERE unit_price < 0
        UNION ALL SELECT id, 'total >= 0' FROM ord WHERE total_amount < 0 UNION ALL SELECT id, 'ended >= started' FROM shift WHERE ended_ms < started_ms"""
    ),
    "dq_uniqueness": cdc("SELECT driver_id, count(*) AS n FROM shift WHERE status = 'ACTIVE' GROUP BY 1 HAVING count(*) > 1"),
    "dq_orphans": cdc("SELECT id, customer_id FROM ord WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 101 <> 0)"),
    "illegal_transitions": cdc(
        f"""SELECT CAST(k AS VARCHAR) AS key, lsn, before AS from_status, status AS to_status,
        CASE WHEN before = status THEN 'noop' WHEN (before, status) IN ({_legal}) THEN 'legal' ELSE 'illegal' END AS verdict FROM trail WHERE before IS NOT NULL"""
    ),
    "terminal_orders": cdc("SELECT status, count(*) AS n FROM steps WHERE status IN ('DELIVERED', 'CANCELLED') GROUP BY 1"),
    "cdc_normalised": cdc(
        """SELECT op, CAST(k AS VARCHAR) AS key, lsn, ts_ms, from_snapshot, before AS before_status, status AS after_status, FALSE AS tombstone, NULL AS error, off AS "offset" FROM ch
        UNION ALL SELECT 'DELETE', CAST(k AS VARCHAR), NULL, NULL, FALSE, NULL, NULL, TRUE, NULL, k * 1000 + 181 FROM trail WHERE i = n AND k % 19 = 0
        UNION ALL SELECT NULL, CAST(k AS VARCHAR), NULL, NULL, FALSE, NULL, NULL, FALSE, 'malformed envelope', k * 1000 + 190 FROM trail WHERE i = n AND k % 1009 = 0"""
    ),
    "cdc_op_counts": cdc(
        """SELECT 'orders' AS "table", op, from_snapshot, FALSE AS tombstone, count(*) AS n FROM ch GROUP BY ALL UNION ALL SELECT 'orders', 'DELETE', FALSE, TRUE, count(*) FROM trail WHERE i = n AND k % 19 = 0"""
    ),
    "cdc_current_orders": cdc("SELECT k AS id, customer_id, status, CAST(total_amount AS VARCHAR) AS total_amount, lsn FROM trail WHERE i = n AND k % 19 <> 0"),
    "cdc_order_history": cdc("SELECT CAST(k AS VARCHAR) AS key, lsn, status, ts_ms AS entered_ms, lead(ts_ms) OVER (PARTITION BY k ORDER BY lsn) - ts_ms AS in_status_ms FROM trail"),
    "cdc_dedup": cdc("SELECT CAST(k AS VARCHAR) AS key, lsn, op FROM dedup"),
    "cdc_changed_columns": cdc("SELECT CAST(k AS VARCHAR) AS key, lsn, 'status' AS changed FROM ch WHERE op = 'UPDATE'"),
    "cdc_lsn_regressions": cdc(
        """SELECT CAST(k AS VARCHAR) AS key, lsn, prev_lsn, off AS "offset" FROM (SELECT *, lag(lsn) OVER (PARTITION BY k ORDER BY off) AS prev_lsn FROM ch) WHERE lsn <= prev_lsn"""
    ),
    "cdc_business_events": cdc(
        f"""SELECT CAST(k AS VARCHAR) AS key, lsn, event_type, ts_ms AS event_ms FROM dedup JOIN (VALUES {_named}) AS m(st, event_type) ON status = st WHERE op <> 'DELETE' AND (before IS NULL OR before <> status)"""
    ),
    "cdc_trail_for_order": cdc("SELECT CAST(k AS VARCHAR) AS key, op, before AS before_status, status AS after_status, lsn FROM dedup WHERE k IN (SELECT max(k) FROM ch WHERE n = 7)"),
    "cdc_state_by_lsn": cdc("SELECT CAST(k AS VARCHAR) AS key, status, lsn FROM trail WHERE i = n"),
    "shift_hours": cdc(f"SELECT driver_id, CAST(sum(coalesce(ended_ms, {NOW_MS}) - started_ms) AS BIGINT) AS on_shift_ms, count(*) AS shifts FROM shift GROUP BY 1"),
    "delivery_route_distance": cdc(
        f"SELECT driver_id, {r2('avg(m)')} AS avg_m, {r2('max(m)')} AS max_m, count(*) AS deliveries FROM (SELECT *, {dist('pickup_lat', 'pickup_lon', 'delivery_lat', 'delivery_lon')} AS m FROM del) GROUP BY 1"
    ),
    "delivery_p95_by_hour": cdc(
        f"""SELECT restaurant_id, assigned_ms - assigned_ms % 3600000 AS hour_ms, {r2('quantile_cont(delivered_ms - assigned_ms, 0.95)')} AS p95_ms, count(*) AS deliveries FROM del WHERE delivered_ms IS NOT NULL GROUP BY 1, 2"""
    ),
    "deliveries_completed_1m": cdc("SELECT delivered_ms - delivered_ms % 60000 AS minute_ms, count(*) AS delivered FROM del WHERE delivered_ms IS NOT NULL GROUP BY 1"),
    "pickup_to_delivered": cdc("SELECT order_id, delivered_ms - picked_up_ms AS latency_ms FROM del WHERE delivered_ms IS NOT NULL"),
    "order_delivery_join": cdc("SELECT ord.id AS order_id, ord.status, del.id AS delivery_id, driver_id FROM ord JOIN del ON ord.id = del.order_id"),
    "fact_dim_enrich": cdc("SELECT del.order_id, c_name, restaurant_id, driver_id FROM del JOIN ord ON ord.id = del.order_id JOIN customer ON c_custkey = customer_id"),
    "pickup_timeouts": cdc(
        "SELECT concat_ws(':', 'ORDER_PICKUP_TIMEOUT', order_id, assigned_ms + 600000) AS alert_id, order_id, driver_id, assigned_ms + 600000 AS event_ms FROM del WHERE picked_up_ms IS NULL OR picked_up_ms - assigned_ms > 600000"
    ),
    "gps_gap_on_delivery": both(
        """SELECT DISTINCT g.driver_id, g.event_ms FROM (SELECT driver_id, event_ms + 90000 AS event_ms FROM (SELECT *, lead(event_ms) OVER (PARTITION BY driver_id ORDER BY event_ms, event_id) AS nxt FROM valid)
        WHERE nxt IS NULL OR nxt - event_ms > 90000) g JOIN del ON del.driver_id = g.driver_id AND g.event_ms BETWEEN picked_up_ms AND coalesce(delivered_ms, picked_up_ms + 3600000)"""
    ),
    "geofence_missed": both(
        """SELECT order_id, driver_id, picked_up_ms AS event_ms FROM del WHERE picked_up_ms IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fence_events f WHERE f.driver_id = del.driver_id
        AND transition = 'ENTER' AND fence_type = 'RESTAURANT' AND f.event_ms BETWEEN assigned_ms AND picked_up_ms)"""
    ),
    "delivery_events_interval_join": both(
        """SELECT order_id, del.driver_id, fence_id, transition, f.event_ms FROM del JOIN fence_events f ON f.driver_id = del.driver_id AND f.event_ms BETWEEN assigned_ms AND coalesce(delivered_ms, picked_up_ms + 3600000)"""
    ),
    "driver_state_enriched": both(
        """SELECT v.driver_id, v.event_ms, v.event_id, (SELECT arg_max(transition, f.event_ms) FROM fence_events f WHERE f.driver_id = v.driver_id AND f.fence_id = 4 AND f.event_ms <= v.event_ms) AS zone_state,
        (SELECT arg_max(order_id, (assigned_ms, order_id)) FROM del WHERE del.driver_id = v.driver_id AND assigned_ms <= v.event_ms) AS current_order,
        (SELECT arg_max(st, since) FROM (SELECT driver_id AS d, started_ms AS since, 'ACTIVE' AS st FROM shift UNION ALL SELECT driver_id, ended_ms, status FROM shift WHERE ended_ms IS NOT NULL) WHERE d = v.driver_id AND since <= v.event_ms) AS shift_status FROM valid v"""
    ),
    "dead_letter_fields": loc(
        """SELECT event_id AS id, CASE WHEN undecodable THEN 'reason,error,topic,partition,offset,rawBase64' ELSE 'reason,driverId,latitude,longitude,eventTime,topic,partition,offset' END AS fields, reason,
        CASE WHEN undecodable THEN 'not decodable' END AS error, CASE WHEN NOT undecodable THEN driver_id END AS "driverId", CASE WHEN NOT undecodable THEN latitude END AS latitude,
        CASE WHEN NOT undecodable THEN longitude END AS longitude, CASE WHEN NOT undecodable THEN event_ms END AS "eventTime", 'driver.location' AS topic, CAST(driver_id % 24 AS INT) AS partition,
        event_id AS "offset", CASE WHEN undecodable THEN base64('\\x00\\xFF'::BLOB || event_id::VARCHAR::BLOB) END AS "rawBase64" FROM gated WHERE reason IS NOT NULL"""
    ),
    "geofence_events_versioned": loc(
        """SELECT driver_id, fence_id, CASE WHEN inside THEN 'ENTER' ELSE 'EXIT' END AS transition, latitude AS lat, longitude AS lon, event_ms FROM (
        SELECT *, coalesce(lag(inside) OVER (PARTITION BY driver_id, fence_id ORDER BY event_ms, event_id), FALSE) AS was FROM (
        SELECT v.*, fence_id, longitude > CASE WHEN event_ms >= 1704067800000 + fence_id * 60000 THEN round((x1 + x2) / 2, 4) ELSE x1 END AND longitude < x2 AND latitude > y1 AND latitude < y2 AS inside
        FROM valid v, fences f)) WHERE inside <> was"""
    ),
    "zone_lookup_json": loc(
        """SELECT event_id, s_suppkey AS fence_id FROM valid, (SELECT s_suppkey, CAST(printf('%.4f', 44.49 + (s_suppkey * 7 % 100) * 0.0005) AS DOUBLE) AS x, CAST(printf('%.4f', 40.165 + (s_suppkey * 13 % 60) * 0.0005) AS DOUBLE) AS y,
        CAST(printf('%.4f', 44.49 + (s_suppkey * 7 % 100) * 0.0005 + 0.002) AS DOUBLE) AS u, CAST(printf('%.4f', 40.165 + (s_suppkey * 13 % 60) * 0.0005 + 0.002) AS DOUBLE) AS w FROM supplier WHERE s_suppkey % 17 NOT IN (3, 5))
        WHERE longitude > x AND longitude < u AND latitude > y AND latitude < w"""
    ),
    "zones_rejected": "SELECT s_suppkey AS id, 'zone ' || s_suppkey AS name FROM supplier WHERE s_suppkey % 17 IN (3, 5)",
    "driver_speed_stats": loc("SELECT count(*) AS processed, count(DISTINCT driver_id) FILTER (speed_kph IS NOT NULL) AS drivers_seen FROM valid"),
    "sink_speed_windows_replay": loc("SELECT * FROM win", windows("valid")),
    "sink_alerts_replay": both(f"SELECT *, event_ms + 2000 AS ingested_at FROM ({_ALERTS})"),
    "derived_topic_scan": both(
        f"""SELECT 'speed.windows' AS topic, driver_id::VARCHAR AS key, window_start || '|' || sample_count AS told FROM win UNION ALL SELECT 'geofence.events', driver_id::VARCHAR, event_id || '|' || transition FROM fence_events
        UNION ALL SELECT 'alerts', alert_id, kind || '|' || coalesce(order_id::VARCHAR, '-') || '|' || event_ms FROM ({_ALERTS})""",
        windows("valid"),
    ),
    "orders_by_status_with_items": cdc(
        """SELECT id, customer_id, ord.status, coalesce(string_agg(line || ':' || quantity || ':' || unit_price, ',' ORDER BY line, quantity, unit_price), '') AS items FROM ord LEFT JOIN items ON id = order_id WHERE ord.status = 'P' GROUP BY ALL"""
    ),
    "dq_unique_keys": cdc(
        """SELECT rule, value, count(*) AS n FROM (
        SELECT 'customers.email' AS rule, 'c' || CASE WHEN c_custkey % 100 = 0 THEN c_custkey - 1 ELSE c_custkey END || '@mail.example' AS value FROM customer
        UNION ALL SELECT 'vehicles.plate', 'P' || CASE WHEN p_partkey % 200 = 0 THEN p_partkey - 1 ELSE p_partkey END FROM part WHERE p_partkey % 300 <> 7
        UNION ALL SELECT 'deliveries.order_id', order_id::VARCHAR FROM del UNION ALL SELECT 'deliveries.order_id', order_id::VARCHAR FROM del WHERE order_id % 500 = 3
        UNION ALL SELECT 'driver_shifts.driver_id active', driver_id::VARCHAR FROM shift WHERE status = 'ACTIVE') GROUP BY ALL HAVING count(*) > 1"""
    ),
    "dq_foreign_keys": cdc(
        """SELECT 'drivers.vehicle_id' AS reference, driver_id AS id, CASE WHEN driver_id % 41 = 0 THEN -driver_id - 1 ELSE driver_id % 97 + 1 END AS missing FROM dr
            WHERE CASE WHEN driver_id % 41 = 0 THEN -driver_id - 1 ELSE driver_id % 97 + 1 END NOT IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'driver_shifts.driver_id', id, driver_id FROM shift WHERE driver_id % 37 = 0
        UNION ALL SELECT 'orders.customer_id', id, customer_id FROM ord WHERE customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 101 <> 0)
        UNION ALL SELECT 'orders.restaurant_id', id, id % 40 % 4 + 1 FROM ord WHERE id % 40 % 4 + 1 NOT IN (1, 2, 3)
        UNION ALL SELECT 'order_items.order_id', line, order_id FROM items WHERE order_id NOT IN (SELECT id FROM ord WHERE id % 211 <> 0)
        UNION ALL SELECT 'deliveries.order_id', id, order_id FROM del WHERE order_id NOT IN (SELECT id FROM ord WHERE id % 211 <> 0)
        UNION ALL SELECT 'deliveries.driver_id', id, driver_id FROM del WHERE driver_id NOT IN (SELECT driver_id FROM dr WHERE driver_id % 37 <> 0)"""
    ),
    "dq_zone_rules": "SELECT s_suppkey AS key, 'polygon is not blank' AS rule FROM supplier WHERE s_suppkey % 17 = 3",
    "fact_dims_enrich": cdc(
        """SELECT del.order_id, c_name AS customer, 'driver ' || dr.driver_id AS driver, CASE p_partkey % 3 WHEN 0 THEN 'BICYCLE' WHEN 1 THEN 'SCOOTER' WHEN 2 THEN 'CAR' END AS vehicle,
        CASE restaurant_id WHEN 1 THEN 'Republic Square pickup' WHEN 2 THEN 'Opera pickup' ELSE 'Cascade pickup' END AS restaurant FROM del JOIN ord ON ord.id = del.order_id JOIN customer ON c_custkey = customer_id
        JOIN dr USING (driver_id) LEFT JOIN part ON p_partkey = CASE WHEN dr.driver_id % 41 = 0 THEN -dr.driver_id - 1 ELSE dr.driver_id % 97 + 1 END"""
    ),
    "cdc_captured_op_counts": cdc(
        """SELECT 'fleet.' || t || '.cdc' AS topic, t AS "table", op, count(*) AS n FROM (
        SELECT 'orders' AS t, op FROM ch UNION ALL SELECT 'orders', 'DELETE' FROM trail WHERE i = n AND k % 19 = 0
        UNION ALL SELECT 'order_items', 'CREATE' FROM items UNION ALL SELECT 'drivers', 'READ' FROM dr
        UNION ALL SELECT 'driver_shifts', 'CREATE' FROM shift UNION ALL SELECT 'driver_shifts', 'UPDATE' FROM shift WHERE ended_ms IS NOT NULL
        UNION ALL SELECT 'deliveries', 'CREATE' FROM del UNION ALL SELECT 'deliveries', 'UPDATE' FROM del, range(CASE WHEN delivered_ms IS NULL THEN 2 ELSE 3 END)) GROUP BY ALL"""
    ),
    "cdc_captured_events": cdc(
        """SELECT CAST(id AS VARCHAR) AS key, id * 10 + 1 AS lsn, 'DRIVER_SHIFT_STARTED' AS event_type, started_ms AS event_ms FROM shift
        UNION ALL SELECT CAST(id AS VARCHAR), id * 10 + 2, 'DRIVER_SHIFT_ENDED', ended_ms FROM shift WHERE ended_ms IS NOT NULL
        UNION ALL SELECT CAST(id AS VARCHAR), id * 10 + 1, 'DRIVER_ASSIGNED', assigned_ms FROM del UNION ALL SELECT CAST(id AS VARCHAR), id * 10 + 2, 'DRIVER_ARRIVED', picked_up_ms - 30000 FROM del"""
    ),
    "cdc_surviving_image": cdc("""SELECT CAST(k AS VARCHAR) AS key, lsn, op, CASE WHEN op = 'DELETE' THEN before ELSE status END AS status, CAST(total_amount AS VARCHAR) AS total_amount, off AS "offset" FROM ch"""),
    "terminal_deliveries": cdc("SELECT CASE WHEN order_id % 29 = 0 THEN 'FAILED' ELSE 'DELIVERED' END AS status, count(*) AS n FROM del WHERE delivered_ms IS NOT NULL GROUP BY 1"),
}
SQL["framed_schema_route"] = SQL["schema_evolution_union"]
