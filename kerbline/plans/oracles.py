"""DuckDB counterparts of the registered queries, written independently on the same tables."""

_EVENTS = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value, props, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         ts + INTERVAL 9 HOUR AS wall, date_trunc('hour', ts) AS hour_at
  FROM events
),
obs AS (
  SELECT event_id AS snapshot_id, ts, epoch_us(ts) AS t, wall, hour_at, user_id % 8 AS route_id, user_id AS veh_id, 'P' || user_id AS plate_no,
         CAST(1000 + k AS BIGINT) AS station_id, k AS station_seq, CAST(floor(value / 10) AS INTEGER) AS remain,
         CASE WHEN floor(value / 10) <= 0 THEN 4 WHEN floor(value / 10) <= 5 THEN 3 WHEN floor(value / 10) <= 12 THEN 2 ELSE 1 END AS crowded,
         CASE WHEN user_id % 8 < 4 THEN 11 WHEN user_id % 8 = 4 THEN 13 END AS rtype, event_type, value
  FROM ev
)"""

_PERIOD = """CASE WHEN hour(wall) IN (7, 8, 9) THEN 'morning_peak' WHEN hour(wall) IN (17, 18, 19) THEN 'evening_peak'
  WHEN hour(wall) IN (5, 6) THEN 'early_morning' WHEN hour(wall) >= 20 THEN 'night' WHEN hour(wall) >= 10 THEN 'daytime' ELSE 'late_night' END"""

_DAY_KO = "['월','화','수','목','금','토','일'][CAST(isodow(wall) AS INTEGER)]"
_KST = "strftime(wall, '%Y-%m-%dT%H:%M:%S') || '+09:00'"
_CROWDED = "CASE crowded WHEN 1 THEN '여유' WHEN 2 THEN '보통' WHEN 3 THEN '혼잡' WHEN 4 THEN '매우혼잡' END"


def _scarcity(remain, cap):
    return (
        f"CASE WHEN {remain} <= 0 THEN 100 WHEN {remain} >= {cap} THEN 0 "
        f"ELSE CAST(round_even(100 * (1 - power(ln({remain} + 1) / ln({cap} + 1), 2.15)), 0) AS INTEGER) END"
    )


_DIMS = """
routes AS (
  SELECT DISTINCT route_id, '50' || route_id || '(a)' AS route_name, '50' || route_id || 'A' AS canonical_route_name, 'type ' || route_id AS route_type_name
  FROM obs WHERE route_id <> 7
),
stops AS (
  SELECT DISTINCT route_id, station_seq, station_id, 'stop ' || station_seq AS station_name, 'M' || station_seq AS mobile_no,
         station_seq / 100 + 126.5 AS x, station_seq / 100 + 37.0 AS y, CASE WHEN station_seq < 50 THEN 'up' ELSE 'down' END AS dir
  FROM obs WHERE station_seq % 10 <> 0
),
caps AS (SELECT route_id, plate_no, max(remain) AS cap FROM obs WHERE remain >= 0 GROUP BY ALL),
rcaps AS (SELECT route_id, max(remain) AS cap FROM obs WHERE remain >= 0 GROUP BY ALL)"""

_BASE = f"""
base0 AS (
  SELECT o.*, r.route_name, r.canonical_route_name, r.route_type_name, coalesce(o.rtype, 11) AS route_type_cd, s.station_name, s.mobile_no, s.x, s.y,
         CASE WHEN coalesce(o.rtype, 11) = 13 THEN CASE WHEN c.cap > 0 THEN c.cap END ELSE greatest(45, c.cap) END AS cap
  FROM obs o JOIN routes r USING (route_id) LEFT JOIN stops s ON s.route_id = o.route_id AND s.station_seq = o.station_seq
  LEFT JOIN caps c ON c.route_id = o.route_id AND c.plate_no = o.plate_no
),
base AS (
  SELECT snapshot_id, t, wall, hour_at, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS collected_at_utc, {_KST} AS collected_at_kst,
         CAST(CAST(wall AS DATE) AS VARCHAR) AS service_date, CAST(isodow(wall) - 1 AS INTEGER) AS day_of_week, {_DAY_KO} AS day_name_ko,
         CASE WHEN isodow(wall) >= 6 THEN 1 ELSE 0 END AS is_weekend, CAST(hour(wall) AS INTEGER) AS hour, CAST(minute(wall) AS INTEGER) AS minute,
         printf('%02d:%02d', hour(wall), minute(wall) // 10 * 10) AS time_bucket_10m, {_PERIOD} AS time_period,
         route_id, route_name, canonical_route_name, route_type_cd, route_type_name, veh_id, plate_no, station_id, station_seq, station_name, mobile_no, x, y,
         remain AS remain_seat_cnt, crowded, {_CROWDED} AS crowded_label, 2 AS state_cd, 1 AS low_plate, 0 AS tagless_cd, cap AS estimated_capacity,
         {_scarcity("remain", "coalesce(cap, 45)")} AS seat_scarcity_score,
         CASE WHEN remain = 0 THEN 1 ELSE 0 END AS is_no_seat, CASE WHEN remain <= 2 THEN 1 ELSE 0 END AS is_low_seat_2,
         CASE WHEN remain <= 5 THEN 1 ELSE 0 END AS is_low_seat_5
  FROM base0
)"""

_WEATHER = """
weather AS (
  SELECT CAST(user_id % 3 AS VARCHAR) AS key, make_timestamp(CAST(epoch_us(hour_at) // 32400000000 * 32400000000 AS BIGINT)) AS obs_at, max(value) AS temperature, min(value) AS precipitation, CAST(count(*) AS DOUBLE) AS humidity,
         CAST(max(user_id) AS DOUBLE) AS wind_speed, CAST(min(user_id) AS DOUBLE) AS cloud_amount
  FROM ev WHERE event_type = 'error' GROUP BY ALL
),
weather_t AS (
  SELECT *, CASE WHEN precipitation - 10 > 0 THEN 'rain' WHEN cloud_amount % 10 >= 8 THEN 'cloudy' WHEN cloud_amount % 10 >= 3 THEN 'partly_cloudy' ELSE 'clear' END AS weather_text
  FROM weather
)"""
_AIR = """
air AS (
  SELECT CAST(user_id % 3 AS VARCHAR) AS key, make_timestamp(CAST(epoch_us(hour_at) // 32400000000 * 32400000000 AS BIGINT)) AS obs_at, max(value) AS pm10, min(value) AS pm25, max(value) AS o3, min(value) AS khai,
         CASE WHEN min(value) > 10 THEN 'bad' ELSE 'good' END AS air_quality_grade
  FROM ev WHERE event_type = 'view' GROUP BY ALL
)"""
_TRAFFIC = """
traffic AS (
  SELECT CAST(user_id % 3 AS VARCHAR) AS key, make_timestamp(CAST(epoch_us(hour_at) // 32400000000 * 32400000000 AS BIGINT)) AS obs_at, max(value) AS avg_speed, min(value) AS traffic_volume, CAST(max(user_id) AS DOUBLE) AS delay_time,
         CAST(count(*) AS INTEGER) AS congestion_level
  FROM ev WHERE event_type = 'click' GROUP BY ALL
)"""


def _nearest(name, table):
    """Closest row within three hours per distinct hour: a plain range join, then a row number."""
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT h.hour_at, c.*, abs(epoch_us(c.obs_at) - epoch_us(h.hour_at)) AS gap,
           row_number() OVER (PARTITION BY h.hour_at ORDER BY abs(epoch_us(c.obs_at) - epoch_us(h.hour_at)), c.obs_at, c.key) AS rn
    FROM (SELECT DISTINCT hour_at FROM obs) h
    JOIN {table} c ON c.obs_at BETWEEN h.hour_at - INTERVAL 3 HOUR AND h.hour_at + INTERVAL 3 HOUR
  ) WHERE rn = 1
)"""


_DAYS = """
hol AS (
  SELECT CAST(ts AS DATE) AS d, CASE WHEN max(value) > 300 THEN 1 ELSE 0 END AS is_holiday, 'day ' || max(user_id) AS holiday_name
  FROM ev WHERE event_type = 'signup' GROUP BY ALL
),
area AS (
  SELECT 'area' || (user_id % 4) AS area_key, CAST(ts AS DATE) AS d, CAST(count(*) AS INTEGER) AS event_count, CAST(count(DISTINCT user_id) AS INTEGER) AS event_nearby_count
  FROM ev WHERE event_type = 'purchase' GROUP BY ALL
),
evd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY area_key) AS rn FROM area) WHERE rn = 1)"""

_MODEL = f"""
model AS (
  SELECT b.snapshot_id, b.collected_at_kst, strftime(b.hour_at + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS observed_hour_kst, b.service_date,
         b.day_of_week, b.day_name_ko, b.is_weekend, coalesce(h.is_holiday, 0) AS is_holiday, coalesce(h.holiday_name, '') AS holiday_name, b.hour,
         b.time_bucket_10m, b.time_period, b.route_id, b.route_name, b.canonical_route_name, b.route_type_cd, b.route_type_name, b.veh_id, b.plate_no,
         b.station_id, b.station_seq, coalesce(b.station_name, 'unknown') AS station_name, coalesce(b.mobile_no, 'unknown') AS mobile_no,
         coalesce(b.x, 0.0) AS x, coalesce(b.y, 0.0) AS y, b.remain_seat_cnt, b.crowded, b.crowded_label, coalesce(b.estimated_capacity, 45) AS estimated_capacity,
         b.seat_scarcity_score, b.is_no_seat, b.is_low_seat_2, b.is_low_seat_5,
         coalesce(w.temperature, 0.0) AS temperature, coalesce(w.precipitation, 0.0) AS precipitation, coalesce(w.humidity, 0.0) AS humidity,
         coalesce(w.wind_speed, 0.0) AS wind_speed, coalesce(w.cloud_amount, 0.0) AS cloud_amount, coalesce(w.weather_text, 'unknown') AS weather_text,
         CASE WHEN w.gap = 0 THEN 0 ELSE 1 END AS weather_imputed,
         coalesce(a.pm10, 0.0) AS pm10, coalesce(a.pm25, 0.0) AS pm25, coalesce(a.o3, 0.0) AS o3, coalesce(a.khai, 0.0) AS khai,
         coalesce(a.air_quality_grade, 'unknown') AS air_quality_grade, CASE WHEN a.gap = 0 THEN 0 ELSE 1 END AS air_quality_imputed,
         coalesce(f.avg_speed, 0.0) AS avg_speed, coalesce(f.traffic_volume, 0.0) AS traffic_volume, coalesce(f.delay_time, 0.0) AS delay_time,
         coalesce(f.congestion_level, 0) AS congestion_level, CASE WHEN f.gap = 0 THEN 0 ELSE 1 END AS traffic_imputed,
         coalesce(e.event_count, 0) AS event_count, coalesce(e.event_nearby_count, 0) AS event_nearby_count, CASE WHEN e.d IS NULL THEN 1 ELSE 0 END AS event_imputed
  FROM base b LEFT JOIN near_w w ON w.hour_at = b.hour_at LEFT JOIN near_a a ON a.hour_at = b.hour_at LEFT JOIN near_f f ON f.hour_at = b.hour_at
  LEFT JOIN hol h ON h.d = CAST(b.service_date AS DATE) LEFT JOIN evd e ON e.d = CAST(b.service_date AS DATE)
)"""

_NEAR_W = _nearest("near_w", "weather_t")
_FEATURES = ",".join(
    [_EVENTS, _DIMS, _BASE, _WEATHER, _AIR, _TRAFFIC, _NEAR_W, _nearest("near_a", "air"), _nearest("near_f", "traffic"), _DAYS, _MODEL]
)

_LABELS = """
series AS (SELECT snapshot_id AS id, route_id, veh_id, t, station_seq AS seq, CASE WHEN remain = 0 THEN 1 ELSE 0 END AS no_seat,
                  CASE WHEN remain <= 2 THEN 1 ELSE 0 END AS low2, CASE WHEN remain <= 5 THEN 1 ELSE 0 END AS low5 FROM obs),
h6 AS (SELECT a.id, b.id AS fid, b.no_seat, b.low2 FROM series a JOIN series b ON a.veh_id = b.veh_id AND b.t > a.t AND b.t <= a.t + 21600000000
       QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.t DESC, b.seq DESC, b.id DESC) = 1),
h12 AS (SELECT a.id, b.id AS fid, b.no_seat, b.low2 FROM series a JOIN series b ON a.veh_id = b.veh_id AND b.t > a.t AND b.t <= a.t + 43200000000
       QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.t DESC, b.seq DESC, b.id DESC) = 1),
nxt AS (SELECT a.id, b.id AS fid, b.seq, b.no_seat, b.low2 FROM series a JOIN series b ON a.veh_id = b.veh_id AND b.t >= a.t AND b.t <= a.t + 86400000000 AND b.seq > a.seq
       QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.t, b.seq, b.id) = 1),
labelled AS (
  SELECT s.id AS snapshot_id, s.no_seat AS target_no_seat_now, s.low2 AS target_low_seat_2_now, s.low5 AS target_low_seat_5_now,
         coalesce(h6.no_seat, 0) AS target_no_seat_next_5min, coalesce(h6.low2, 0) AS target_low_seat_2_next_5min, CASE WHEN h6.id IS NULL THEN 0 ELSE 1 END AS has_future_5min,
         coalesce(h12.no_seat, 0) AS target_no_seat_next_10min, coalesce(h12.low2, 0) AS target_low_seat_2_next_10min, CASE WHEN h12.id IS NULL THEN 0 ELSE 1 END AS has_future_10min,
         coalesce(nxt.no_seat, 0) AS target_no_seat_next_station, coalesce(nxt.low2, 0) AS target_low_seat_2_next_station, CASE WHEN nxt.id IS NULL THEN 0 ELSE 1 END AS has_next_station
  FROM series s LEFT JOIN h6 ON h6.id = s.id LEFT JOIN h12 ON h12.id = s.id LEFT JOIN nxt ON nxt.id = s.id
)"""

_RATIOS = (
    "[0.010,0.006,0.004,0.003,0.004,0.015,0.045,0.090,0.105,0.065,0.040,0.035,0.040,0.035,0.035,0.045,0.060,0.090,0.105,0.075,0.045,0.035,0.025,0.015]"
)
_VEHICLES = """
veh AS (SELECT route_id, CAST(isodow(wall) - 1 AS INTEGER) AS day_of_week, CAST(hour(wall) AS INTEGER) AS hour,
               greatest(CAST(count(DISTINCT veh_id) AS DOUBLE), 6.0) AS vehicles_per_hour FROM obs GROUP BY ALL)"""


def _boardings(station, pairs, veh="veh"):
    """Expected boardings over (station, route) pairs."""
    return f"""
davg AS (SELECT station_id, avg(q) AS a FROM (SELECT {station} AS station_id, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY ALL),
pairs AS ({pairs}),
share AS (SELECT station_id, route_id, 1.0 / count(*) OVER (PARTITION BY station_id) AS s FROM pairs),
grid AS (
  SELECT s.station_id, s.route_id, CAST(d.d AS INTEGER) AS day_of_week, CAST(h.h AS INTEGER) AS hour, a.a, CAST(({_RATIOS})[h.h + 1] AS DOUBLE) AS ratio, s.s
  FROM share s JOIN davg a USING (station_id) CROSS JOIN range(7) d(d) CROSS JOIN range(24) h(h)
),
boardings AS (
  SELECT g.station_id, g.route_id, g.day_of_week, g.hour, round_even(g.a, 4) AS station_daily_boarding_avg, g.ratio AS hour_demand_ratio,
         round_even(CAST(g.s AS DOUBLE), 6) AS route_share, round_even(coalesce(v.vehicles_per_hour, 6.0), 4) AS vehicles_per_hour,
         round_even(g.a * g.ratio * g.s / greatest(coalesce(v.vehicles_per_hour, 6.0), 1.0), 6) AS expected_boardings_at_stop
  FROM grid g LEFT JOIN {veh} v ON v.route_id = g.route_id AND v.day_of_week = g.day_of_week AND v.hour = g.hour
)"""


_SUPPLY_PAIRS = "SELECT DISTINCT l_suppkey AS station_id, l_partkey % 8 AS route_id FROM lineitem"
_SUPPLY = f"WITH {_EVENTS},{_VEHICLES},{_boardings('l_suppkey', _SUPPLY_PAIRS)}"

_HISTORY = """
hist AS (
  SELECT snapshot_id, t, CAST(route_id AS VARCHAR) AS route, station_id, station_seq % 20 AS seq, CAST(hour(wall) AS INTEGER) AS hour,
         CASE WHEN isodow(wall) >= 6 THEN 1 ELSE 0 END AS we, CASE WHEN day(wall) % 9 = 0 THEN 1 ELSE 0 END AS ho,
         CASE WHEN remain > 30 THEN -1 ELSE remain END AS remain, crowded, CAST(veh_id % 3 * 5 + 35 AS INTEGER) AS cap,
         CASE WHEN remain <= 2 THEN 1 ELSE 0 END AS y, CASE WHEN snapshot_id % 4 <> 0 THEN 1 ELSE 0 END AS has_next, CAST(wall AS DATE) >= DATE '2024-01-25' AS future
  FROM obs
),
past AS (SELECT * FROM hist WHERE NOT future), fut AS (SELECT * FROM hist WHERE future)"""

_BASELINE = """
r1 AS (SELECT route, seq, hour, count(*) AS n, (sum(y) + 1.0) / (count(*) + 2.0) AS p FROM past GROUP BY ALL),
r2 AS (SELECT route, seq, count(*) AS n, (sum(y) + 1.0) / (count(*) + 2.0) AS p FROM past GROUP BY ALL),
r3 AS (SELECT route, hour, count(*) AS n, (sum(y) + 1.0) / (count(*) + 2.0) AS p FROM past GROUP BY ALL),
r4 AS (SELECT hour, count(*) AS n, (sum(y) + 1.0) / (count(*) + 2.0) AS p FROM past GROUP BY ALL),
r5 AS (SELECT count(*) AS n, (sum(y) + 1.0) / (count(*) + 2.0) AS p FROM past),
scored AS (
  SELECT f.snapshot_id AS row_id, f.t, f.y AS actual, coalesce(r1.p, r2.p, r3.p, r4.p, (SELECT p FROM r5)) AS probability,
         CASE WHEN r1.p IS NOT NULL THEN 'route_station_hour' WHEN r2.p IS NOT NULL THEN 'route_station' WHEN r3.p IS NOT NULL THEN 'route_hour'
              WHEN r4.p IS NOT NULL THEN 'hour' ELSE 'global' END AS rate_level
  FROM fut f LEFT JOIN r1 ON r1.route = f.route AND r1.seq = f.seq AND r1.hour = f.hour LEFT JOIN r2 ON r2.route = f.route AND r2.seq = f.seq
  LEFT JOIN r3 ON r3.route = f.route AND r3.hour = f.hour LEFT JOIN r4 ON r4.hour = f.hour
)"""

_PREDS = """
preds AS (
  SELECT event_id AS row_id, epoch_us(ts) AS t, floor(value) / 500.0 AS probability, CASE WHEN k < 30 OR value > 150 THEN 1 ELSE 0 END AS actual,
         event_type AS grp, CAST(user_id % 8 AS VARCHAR) AS route, k AS seq
  FROM ev
)"""
_SEGMENT = """
seg AS (
  SELECT p.*, CASE WHEN seq <= 0 OR m <= 0 THEN 'unknown' WHEN seq / m <= 0.25 THEN 'origin_0_25' WHEN seq / m <= 0.5 THEN 'early_mid_25_50'
              WHEN seq / m <= 0.75 THEN 'late_mid_50_75' ELSE 'terminal_75_100' END AS segment
  FROM preds p JOIN (SELECT route, max(seq) AS m FROM preds GROUP BY ALL) USING (route)
)"""


def _div(top, bottom):
    return f"coalesce(({top}) / nullif({bottom}, 0), 0.0)"


def _confusion(rows, threshold, group=""):
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""
conf0 AS (
  SELECT {g}count(*) AS n, CAST(sum(CASE WHEN probability >= {threshold} AND actual = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
         CAST(sum(CASE WHEN probability >= {threshold} AND actual = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
         CAST(sum(CASE WHEN probability < {threshold} AND actual = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
         CAST(sum(CASE WHEN probability < {threshold} AND actual = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn, sum((probability - actual) ** 2) AS sq
  FROM {rows} {by}
),
conf AS (
  SELECT {g}n AS rows, round_even((tp + fn) / n, 6) AS positive_rate, round_even((tp + tn) / n, 6) AS accuracy, round_even({_div('tp', 'tp + fp')}, 6) AS precision,
         round_even({_div('tp', 'tp + fn')}, 6) AS recall,
         round_even({_div(f"2 * {_div('tp', 'tp + fp')} * {_div('tp', 'tp + fn')}", f"{_div('tp', 'tp + fp')} + {_div('tp', 'tp + fn')}")}, 6) AS f1,
         round_even(sq / n, 6) AS brier_score
  FROM conf0
)"""


def _ranked(rows, group=""):
    """AUC from tie-averaged ranks and the top-decile mean, over plain window functions."""
    part = f"PARTITION BY {group}" if group else ""
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""
ranks AS (
  SELECT *, rank() OVER ({part} ORDER BY probability) + (count(*) OVER (PARTITION BY {g}probability) - 1) / 2.0 AS r,
         row_number() OVER ({part} ORDER BY probability DESC, t, row_id) AS rn, count(*) OVER ({part}) AS n_all
  FROM {rows}
),
auc AS (
  SELECT {g}round_even(coalesce((sum(r) FILTER (actual = 1) - sum(actual) * (sum(actual) + 1) / 2.0) / nullif(sum(actual) * (count(*) - sum(actual)), 0), 0.5), 6) AS roc_auc
  FROM ranks {by}
),
top AS (SELECT {g}round_even(avg(actual), 6) AS top_decile_precision FROM ranks WHERE rn <= greatest(1, ceil(n_all * 0.1)) {by})"""


def _curve(rows, thresholds, group=""):
    g = f"{group}, " if group else ""
    body = " UNION ALL ".join(f"SELECT *, CAST({t} AS DOUBLE) AS threshold FROM {rows}" for t in thresholds)
    return f"""
curve0 AS (
  SELECT {g}threshold, count(*) AS n, CAST(count(*) FILTER (probability >= threshold AND actual = 1) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (probability >= threshold AND actual = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (probability < threshold AND actual = 1) AS DOUBLE) AS fn,
         CAST(count(*) FILTER (probability < threshold AND actual = 0) AS DOUBLE) AS tn
  FROM ({body}) GROUP BY {g}threshold
),
curve AS (
  SELECT {g}threshold, CAST(tp + fp AS BIGINT) AS predicted_positive, round_even((tp + fp) / n, 6) AS alert_rate, round_even((tp + tn) / n, 6) AS accuracy,
         round_even({_div('tp', 'tp + fp')}, 6) AS precision, round_even({_div('tp', 'tp + fn')}, 6) AS recall,
         round_even({_div(f"2 * {_div('tp', 'tp + fp')} * {_div('tp', 'tp + fn')}", f"{_div('tp', 'tp + fp')} + {_div('tp', 'tp + fn')}")}, 6) AS f1
  FROM curve0
)"""


_T10 = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
_T13 = (0.01, 0.02, 0.05) + _T10
_SEGMENT_BEST = """
best AS (SELECT * FROM curve QUALIFY row_number() OVER (PARTITION BY segment ORDER BY f1 DESC, precision DESC, threshold DESC) = 1),
segbest AS (
  SELECT s.segment, s.rows, s.positive_rate, b.threshold AS recommended_threshold, b.precision AS recommended_precision, b.recall AS recommended_recall,
         b.f1 AS recommended_f1, b.alert_rate AS recommended_alert_rate, d.precision AS default09_precision, d.recall AS default09_recall, d.f1 AS default09_f1
  FROM (SELECT segment, count(*) AS rows, round_even(avg(actual), 6) AS positive_rate FROM seg GROUP BY ALL) s
  JOIN best b ON b.segment = s.segment LEFT JOIN curve d ON d.segment = s.segment AND d.threshold = 0.9
)"""

_BINS = """
binned AS (SELECT least(9, CASE WHEN probability >= 0.9 THEN 9 WHEN probability >= 0.8 THEN 8 WHEN probability >= 0.7 THEN 7 WHEN probability >= 0.6 THEN 6 WHEN probability >= 0.5 THEN 5
    WHEN probability >= 0.4 THEN 4 WHEN probability >= 0.3 THEN 3 WHEN probability >= 0.2 THEN 2 WHEN probability >= 0.1 THEN 1 ELSE 0 END) AS b, * FROM preds),
bins AS (SELECT b, count(*) AS n, avg(probability) AS p, avg(actual) AS y FROM binned GROUP BY ALL)"""

_ARRIVALS = """
arr AS (
  SELECT o_orderkey AS request_id, o_orderkey % 100 + 1000 AS station_id, o_custkey % 10 AS route_id, '50' || (o_custkey % 10) || '(a)' AS route_name,
         CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 100 AS INTEGER) END AS sta_order, epoch_us(TIMESTAMP '2024-01-10 00:00:00') + o_orderkey * 61000000 AS t, o_orderkey AS key, o_custkey AS cust
  FROM orders
),
slots AS (
  SELECT *, CASE WHEN key % 5 <> 0 THEN vehicle END AS veh_id, 'P' || vehicle AS plate_no, CAST(key % 30 AS INTEGER) AS predict_time,
         CASE WHEN key % 7 <> 0 THEN CAST((key + arrival_slot - 1) % 46 AS INTEGER) END AS remain_seat_cnt, CASE WHEN key % 4 <> 0 THEN CAST(key % 4 + 1 AS INTEGER) END AS crowded
  FROM (
    SELECT *, 1 AS arrival_slot, cust % 200 AS vehicle FROM arr WHERE key % 3 <> 0
    UNION ALL SELECT *, 2 AS arrival_slot, (cust + 1) % 200 AS vehicle FROM arr WHERE (key + 1) % 3 <> 0
  )
)"""
_MATCHED = """
last_veh AS (SELECT route_id, veh_id, plate_no, station_seq, station_id, remain, crowded FROM obs QUALIFY row_number() OVER (PARTITION BY veh_id ORDER BY t DESC, snapshot_id DESC) = 1),
matched AS (
  SELECT s.*, coalesce(v.veh_id, p.veh_id) AS m_veh, coalesce(v.plate_no, p.plate_no) AS m_plate, coalesce(v.station_seq, p.station_seq) AS m_seq,
         coalesce(v.station_id, p.station_id) AS m_station, coalesce(v.remain, p.remain) AS m_remain, coalesce(v.crowded, p.crowded) AS m_crowded
  FROM slots s LEFT JOIN last_veh v ON v.route_id = s.route_id AND v.veh_id = s.veh_id LEFT JOIN last_veh p ON p.route_id = s.route_id AND p.plate_no = s.plate_no
)"""
_STOP_BY_ID = "by_id AS (SELECT * FROM stops QUALIFY row_number() OVER (PARTITION BY route_id, station_id ORDER BY station_seq) = 1)"


def _clock(hour, minute):
    return f"printf('%02d:%02d', ({hour}) % 24, ({minute}) % 60)"


def _timetable():
    """Long timetable: the day type's own field, else the undated one."""
    parts = []
    for i, day in enumerate(("weekday", "saturday", "sunday_holiday")):
        for j, direction in enumerate(("up", "down")):
            first = f"CASE WHEN (n + {i} + {j}) % 5 <> 0 THEN {_clock(f'n % 4 + 4 + {i}', f'n * 7 + {j} * 10')} WHEN n % 3 <> 0 THEN {_clock('n % 3 + 5', f'n + {j}')} END"
            last = f"CASE WHEN (n + {i}) % 6 <> 0 THEN {_clock(f'n % 5 + 20 + {j} + {i}', 'n * 11')} ELSE {_clock('n % 3 + 22', 'n + 5')} END"
            peak = f"CASE WHEN (n + {i}) % 3 <> 0 THEN n + 8 ELSE 12 END"
            off = f"CASE WHEN (n + {i}) % 4 <> 0 THEN n + 15 ELSE 25 END"
            parts.append(f"SELECT n AS route_id, '{direction}' AS direction, '{day}' AS day_type, {first} AS first, {last} AS last, {peak} AS peak, {off} AS off_peak FROM nat")
    return "nat AS (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation),\ntimetable AS (" + "\nUNION ALL ".join(parts) + ")"


_CONTEXT = """
req1 AS (
  SELECT r.*, wall_us // 86400000000 AS dayno, (wall_us // 60000000) % 1440 AS minute FROM (SELECT *, at_us + 32400000000 AS wall_us FROM req) r
),
req2 AS (
  SELECT r.*, DATE '1970-01-01' + CAST(dayno AS INTEGER) AS today, DATE '1970-01-01' + CAST(dayno - 1 AS INTEGER) AS yesterday FROM req1 r
),
req3 AS (
  SELECT r.*, CASE WHEN coalesce(h.is_holiday, 0) = 1 OR isodow(today) = 7 THEN 'sunday_holiday' WHEN isodow(today) = 6 THEN 'saturday' ELSE 'weekday' END AS day_now,
         CASE WHEN coalesce(g.is_holiday, 0) = 1 OR isodow(yesterday) = 7 THEN 'sunday_holiday' WHEN isodow(yesterday) = 6 THEN 'saturday' ELSE 'weekday' END AS day_before
  FROM req2 r LEFT JOIN hol h ON h.d = r.today LEFT JOIN hol g ON g.d = r.yesterday
),
req4 AS (
  SELECT r.*, CAST(split_part(b.first, ':', 1) AS INTEGER) * 60 + CAST(split_part(b.first, ':', 2) AS INTEGER) AS b_first,
         CAST(split_part(b.last, ':', 1) AS INTEGER) * 60 + CAST(split_part(b.last, ':', 2) AS INTEGER) AS b_last
  FROM req3 r LEFT JOIN timetable b ON b.route_id = r.route_id AND b.direction = r.direction AND b.day_type = r.day_before
),
req5 AS (SELECT *, coalesce(b_first > b_last AND minute <= b_last, false) AS overnight FROM req4),
req6 AS (
  SELECT r.*, CASE WHEN overnight THEN yesterday ELSE today END AS service_date, CASE WHEN overnight THEN day_before ELSE day_now END AS day_type FROM req5 r
),
req7 AS (
  SELECT r.*, f.first, f.last, f.peak, f.off_peak, CAST(split_part(f.first, ':', 1) AS INTEGER) * 60 + CAST(split_part(f.first, ':', 2) AS INTEGER) AS f_min,
         CAST(split_part(f.last, ':', 1) AS INTEGER) * 60 + CAST(split_part(f.last, ':', 2) AS INTEGER) AS l_min
  FROM req6 r LEFT JOIN timetable f ON f.route_id = r.route_id AND f.direction = r.direction AND f.day_type = r.day_type
),
req8 AS (
  SELECT *, coalesce(CASE WHEN f_min IS NULL OR l_min IS NULL THEN false WHEN f_min <= l_min THEN minute BETWEEN f_min AND l_min ELSE minute >= f_min OR minute <= l_min END, false) AS operating FROM req7
),
req9 AS (
  SELECT *, CASE WHEN operating THEN wall_us WHEN f_min IS NOT NULL THEN (dayno + CASE WHEN minute > f_min THEN 1 ELSE 0 END) * 86400000000 + CAST(f_min AS BIGINT) * 60000000 END AS proxy_wall FROM req8
),
sched AS (SELECT *, (coalesce(proxy_wall, wall_us) // 3600000000) % 24 AS phour FROM req9)"""

_PROXY_LEVELS = (
    ("route_station_hour_daytype", ("route", "station_id", "hour", "we", "ho")),
    ("route_station_adjacent_hour_daytype", ("route", "station_id", "hour", "we", "ho")),
    ("route_station_hour", ("route", "station_id", "hour")),
    ("route_station_daytype", ("route", "station_id", "we", "ho")),
    ("route_station", ("route", "station_id")),
    ("route_station_seq_hour", ("route", "seq", "hour")),
    ("route_hour", ("route", "hour")),
    ("route", ("route",)),
    ("hour", ("hour",)),
)
_PROXY_KEYS = ("route", "station_id", "seq", "hour", "we", "ho")


def _proxy(source, rated):
    """All levels from raw rows: sorted lists for the medians, counted values for the mode."""
    parts = []
    for level, keys in _PROXY_LEVELS:
        rows = source
        if "adjacent" in level:
            rows = f"(SELECT h.* REPLACE (CAST(h.hour + s.s AS INTEGER) AS hour) FROM {source} h CROSS JOIN (VALUES (-1), (0), (1)) s(s) WHERE h.hour + s.s BETWEEN 0 AND 23)"
        cells = ", ".join(f"CAST({k if k in keys else 'NULL'} AS VARCHAR) AS {k}" for k in _PROXY_KEYS)
        parts.append(f"SELECT '{level}' AS level, {cells}, remain, crowded, cap, y, has_next FROM {rows}")
    every = "\nUNION ALL ".join(parts)
    keys = ", ".join(_PROXY_KEYS)
    return f"""
lv AS ({every}),
modes AS (SELECT level, {keys}, crowded FROM (SELECT level, {keys}, crowded, count(*) AS n FROM lv WHERE crowded IS NOT NULL GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY level, {keys} ORDER BY n DESC, crowded) = 1),
stats0 AS (
  SELECT level, {keys}, count(*) AS n, count(*) FILTER ({rated}) AS n_rated, sum(y) FILTER ({rated}) AS n_full, count(*) FILTER (remain = 0) AS n_now,
         list_sort(list(remain) FILTER (remain >= 0)) AS seats, list_sort(list(cap) FILTER (cap > 0)) AS caps
  FROM lv GROUP BY ALL
),
stats AS (
  SELECT s.level, {", ".join(f"s.{k}" for k in _PROXY_KEYS)}, s.n AS historical_proxy_rows, round_even(CAST(s.n_full AS DOUBLE) / nullif(s.n_rated, 0), 6) AS next_rate,
         round_even(CAST(s.n_now AS DOUBLE) / s.n, 6) AS now_rate, s.seats[len(s.seats) // 2 + 1] AS p_seats, m.crowded AS p_crowded, s.caps[len(s.caps) // 2 + 1] AS p_cap
  FROM stats0 s LEFT JOIN modes m ON m.level = s.level AND {" AND ".join(f"m.{k} IS NOT DISTINCT FROM s.{k}" for k in _PROXY_KEYS)}
)"""


def _fallback(probes):
    """First level that knows the probe."""
    joins, pick = [], []
    for i, (level, keys) in enumerate(_PROXY_LEVELS):
        on = " AND ".join(f"s{i}.{k} = CAST(p.{k} AS VARCHAR)" for k in keys)
        joins.append(f"LEFT JOIN (SELECT * FROM stats WHERE level = '{level}') s{i} ON {on}")
        pick.append(f"WHEN s{i}.level IS NOT NULL THEN s{i}")
    chosen = "CASE " + " ".join(pick) + " END"
    return f"picked AS (SELECT p.*, {chosen} AS st FROM {probes} p {' '.join(joins)})"


_CONFIDENCE = """CASE WHEN g = 'route_station_hour_daytype' AND n >= 20 THEN 'high'
  WHEN g IN ('route_station_hour_daytype', 'route_station_adjacent_hour_daytype', 'route_station_daytype') AND n >= 10 THEN 'medium'
  WHEN g NOT IN ('none', 'hour') AND n >= 5 THEN 'low' ELSE 'very_low' END"""

_LIVE = f"""
live0 AS (
  SELECT m.*, coalesce(m_seq, sta_order, 0) AS l_seq, coalesce(m_station, station_id) AS l_station, coalesce(remain_seat_cnt, m_remain, -1) AS l_remain, coalesce(m.crowded, m_crowded, 0) AS l_crowded,
         coalesce(nullif(m.veh_id, 0), m_veh, 0) AS l_veh FROM matched m
),
live1 AS (
  SELECT l.*, coalesce(q.station_name, i.station_name, 'unknown') AS station_name, coalesce(r.canonical_route_name, '50' || l.route_id || 'A') AS canonical_route_name,
         coalesce(n.station_name, 'unknown') AS requested_station_name, coalesce(nullif(c.cap, 0), 45) AS l_cap, make_timestamp(l.t + 32400000000) AS wall
  FROM live0 l LEFT JOIN routes r ON r.route_id = l.route_id LEFT JOIN stops q ON q.route_id = l.route_id AND q.station_seq = l.l_seq LEFT JOIN by_id i ON i.route_id = l.route_id AND i.station_id = l.l_station
  LEFT JOIN by_id n ON n.route_id = l.route_id AND n.station_id = l.station_id LEFT JOIN caps c ON c.route_id = l.route_id AND c.plate_no = l.plate_no
)"""

_SCHEDULED = f"""
h2 AS (SELECT canonical_route_name AS route, station_id, station_seq AS seq, hour, is_weekend AS we, 0 AS ho, remain_seat_cnt AS remain, crowded, estimated_capacity AS cap, is_no_seat AS y, 1 AS has_next FROM base),
{_proxy("h2", "has_next = 1")},
a1 AS (SELECT a.*, coalesce(a.sta_order, i.station_seq) AS seq FROM arr a LEFT JOIN by_id i ON i.route_id = a.route_id AND i.station_id = a.station_id),
a2 AS (
  SELECT a.*, coalesce(q.station_name, i.station_name, 'unknown') AS station_name, coalesce(q.dir, i.dir, CASE WHEN a.sta_order > 40 THEN 'down' ELSE 'up' END) AS direction
  FROM a1 a LEFT JOIN stops q ON q.route_id = a.route_id AND q.station_seq = a.seq LEFT JOIN by_id i ON i.route_id = a.route_id AND i.station_id = a.station_id
),
req AS (SELECT *, t AS at_us FROM a2),
{_timetable()},
{_CONTEXT},
probe AS (
  SELECT s.request_id, s.route_id, s.station_id, coalesce(r.canonical_route_name, '50' || s.route_id || 'A') AS route, s.seq, s.station_name, s.direction, s.operating,
         make_timestamp(coalesce(s.proxy_wall, s.wall_us)) AS pw, CAST(hour(make_timestamp(coalesce(s.proxy_wall, s.wall_us))) AS INTEGER) AS hour,
         CASE WHEN isodow(make_timestamp(coalesce(s.proxy_wall, s.wall_us))) >= 6 THEN 1 ELSE 0 END AS we, CASE WHEN coalesce(h.is_holiday, 0) = 1 THEN 1 ELSE 0 END AS ho
  FROM sched s LEFT JOIN routes r ON r.route_id = s.route_id LEFT JOIN hol h ON h.d = CAST(make_timestamp(coalesce(s.proxy_wall, s.wall_us)) AS DATE)
),
{_fallback("probe")}"""

_LIVE_CTES = ",".join([_EVENTS, _DIMS, _ARRIVALS, _MATCHED, _STOP_BY_ID, _LIVE])
_SCHEDULED_CTES = ",".join([_EVENTS, _DIMS, _BASE, _DAYS, _ARRIVALS, _STOP_BY_ID, _SCHEDULED])

_TRAIN_SIZE = "greatest(1, least(n - 1, floor(n * (1.0::DOUBLE - 0.2))))"

_OBS = f"WITH {_EVENTS} "
_OBS_BASE = f"WITH {_EVENTS},{_DIMS},{_BASE} "
_OBS_LABELS = f"WITH {_EVENTS},{_LABELS} "
_OBS_PREDS = f"WITH {_EVENTS},{_PREDS}"
_OBS_HIST = f"WITH {_EVENTS},{_HISTORY}"
_FEAT = f"WITH {_FEATURES} "

ORACLES = {
    "next_stop_full_rate": _OBS_LABELS
    + f"""SELECT o.route_id, {_PERIOD} AS time_period, count(*) AS observations, CAST(sum(l.target_no_seat_next_station) AS BIGINT) AS next_full,
          round_even(avg(l.target_no_seat_next_station), 6) AS next_full_rate
          FROM labelled l JOIN obs o USING (snapshot_id) WHERE l.has_next_station = 1 GROUP BY ALL""",
    "label_horizon": _OBS_LABELS + "SELECT id AS snapshot_id, fid AS future_id, no_seat AS future_no_seat FROM h6",
    "label_next_stop": _OBS_LABELS + "SELECT id AS snapshot_id, fid AS next_id, CAST(seq AS BIGINT) AS next_seq FROM nxt",
    "label_table": _OBS_LABELS + "SELECT * FROM labelled",
    "label_summary": _OBS_LABELS
    + """SELECT count(*) AS processed, CAST(sum(has_future_5min) AS BIGINT) AS has_future_5min, CAST(sum(has_future_10min) AS BIGINT) AS has_future_10min,
         CAST(sum(has_next_station) AS BIGINT) AS has_next_station FROM labelled""",
    "base_features": _OBS_BASE + "SELECT * EXCLUDE (t, wall, hour_at) FROM base",
    "observed_capacity": f"WITH {_EVENTS},{_DIMS} SELECT c.route_id, c.plate_no, c.cap AS observed_capacity, r.cap AS route_capacity FROM caps c JOIN rcaps r USING (route_id)",
    "nearest_context": f"WITH {_EVENTS},{_WEATHER},{_NEAR_W} "
    + """SELECT o.snapshot_id, coalesce(w.temperature, 0.0) AS temperature, coalesce(w.precipitation, 0.0) AS precipitation, coalesce(w.humidity, 0.0) AS humidity,
         coalesce(w.wind_speed, 0.0) AS wind_speed, coalesce(w.cloud_amount, 0.0) AS cloud_amount, coalesce(w.weather_text, 'unknown') AS weather_text,
         CASE WHEN w.gap = 0 THEN 0 ELSE 1 END AS weather_imputed FROM obs o LEFT JOIN near_w w ON w.hour_at = o.hour_at""",
    "nearest_context_by_key": f"WITH {_EVENTS},{_WEATHER} "
    + """SELECT o.snapshot_id, coalesce(w.temperature, 0.0) AS temperature, coalesce(w.humidity, 0.0) AS humidity, CASE WHEN w.gap = 0 THEN 0 ELSE 1 END AS weather_imputed
         FROM obs o LEFT JOIN (
           SELECT * FROM (SELECT o.snapshot_id, c.temperature, c.humidity, abs(epoch_us(c.obs_at) - epoch_us(o.hour_at)) AS gap,
             row_number() OVER (PARTITION BY o.snapshot_id ORDER BY abs(epoch_us(c.obs_at) - epoch_us(o.hour_at)), c.obs_at) AS rn
             FROM obs o JOIN weather c ON c.key = CAST(o.veh_id % 3 AS VARCHAR) AND c.obs_at BETWEEN o.hour_at - INTERVAL 3 HOUR AND o.hour_at + INTERVAL 3 HOUR) WHERE rn = 1
         ) w USING (snapshot_id)""",
    "holiday_join": f"WITH {_EVENTS},{_DAYS} "
    + """SELECT o.snapshot_id, coalesce(h.is_holiday, 0) AS is_holiday, coalesce(h.holiday_name, '') AS holiday_name,
         CASE WHEN coalesce(h.is_holiday, 0) = 1 OR isodow(wall) = 7 THEN 'sunday_holiday' WHEN isodow(wall) = 6 THEN 'saturday' ELSE 'weekday' END AS day_type
         FROM obs o LEFT JOIN hol h ON h.d = CAST(o.wall AS DATE)""",
    "event_first_match": f"WITH {_EVENTS},{_DAYS} "
    + """SELECT o.snapshot_id, coalesce(e.event_count, 0) AS event_count, coalesce(e.event_nearby_count, 0) AS event_nearby_count, CASE WHEN e.d IS NULL THEN 1 ELSE 0 END AS event_imputed
         FROM obs o LEFT JOIN evd e ON e.d = CAST(o.wall AS DATE)""",
    "model_features": _FEAT + "SELECT * FROM model",
    "feature_summary": _FEAT
    + """SELECT count(*) AS processed, CAST(sum(weather_imputed) AS BIGINT) AS weather_imputed, CAST(sum(air_quality_imputed) AS BIGINT) AS air_quality_imputed,
         CAST(sum(traffic_imputed) AS BIGINT) AS traffic_imputed, CAST(sum(event_imputed) AS BIGINT) AS event_imputed FROM model""",
    "snapshot_date_range": _OBS_BASE + "SELECT min(service_date) AS start_date, max(service_date) AS end_date FROM base",
    "live_calendar": _OBS
    + f"""SELECT snapshot_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS collected_at_utc, {_KST} AS collected_at_kst, CAST(CAST(wall AS DATE) AS VARCHAR) AS service_date,
          CAST(isodow(wall) - 1 AS INTEGER) AS day_of_week, {_DAY_KO} AS day_name_ko, CASE WHEN isodow(wall) >= 6 THEN 1 ELSE 0 END AS is_weekend,
          CASE WHEN snapshot_id % 2 = 0 THEN 30 ELSE CAST(hour(wall) AS INTEGER) END AS hour, CAST(minute(wall) AS INTEGER) AS minute,
          printf('%02d:%02d', hour(wall), minute(wall) // 10 * 10) AS time_bucket_10m, {_PERIOD} AS time_period FROM obs""",
    "station_daily_avg": "SELECT station_id, round(avg(q), 6) AS station_daily_boarding_avg FROM (SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY ALL",
    "route_share": f"SELECT station_id, route_id, round(1.0 / count(*) OVER (PARTITION BY station_id), 6)::DOUBLE AS route_share FROM ({_SUPPLY_PAIRS})",
    "vehicles_per_hour": f"WITH {_EVENTS},{_VEHICLES} SELECT * FROM veh",
    "expected_boardings": _SUPPLY + " SELECT * FROM boardings",
    "boardings_summary": _SUPPLY
    + " SELECT (SELECT count(*) FROM boardings) AS processed, (SELECT count(*) FROM davg) AS stations, (SELECT count(DISTINCT route_id) FROM pairs) AS routes",
    "boardings_lookup": _SUPPLY
    + """ SELECT o.snapshot_id, coalesce(b.expected_boardings_at_stop, -1.0) AS expected_boardings_at_stop FROM obs o LEFT JOIN boardings b
          ON b.station_id = o.veh_id % 100 AND b.route_id = o.route_id AND b.day_of_week = isodow(o.wall) - 1 AND b.hour = hour(o.wall)""",
    "event_days": """
      WITH spans AS (
        SELECT greatest(CAST(o_orderdate AS DATE), DATE '1995-03-01') AS a,
               least(CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 5 AS INTEGER) ELSE CAST(o_orderdate AS DATE) END, DATE '1999-06-30') AS b
        FROM orders
      ), days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM spans WHERE a <= b)
      SELECT 'global' AS area_key, CAST(d AS VARCHAR) AS service_date, count(*) AS event_count, count(*) AS event_nearby_count FROM days GROUP BY d""",
    "training_set": f"WITH {_FEATURES},{_LABELS},"
    + "vehb AS (SELECT route_id, day_of_week, hour, greatest(CAST(count(DISTINCT veh_id) AS DOUBLE), 6.0) AS vehicles_per_hour FROM base GROUP BY ALL),"
    + _boardings("l_suppkey % 90 + 1001", "SELECT DISTINCT station_id, route_id FROM stops", "vehb")
    + """ SELECT m.snapshot_id, m.route_id, m.station_seq, m.hour, m.remain_seat_cnt, m.temperature, m.weather_imputed, m.event_count,
          coalesce(b.expected_boardings_at_stop, 0.0) AS expected_boardings_at_stop, CASE WHEN b.expected_boardings_at_stop IS NULL THEN 1 ELSE 0 END AS expected_boardings_missing,
          l.target_no_seat_next_station, l.target_no_seat_next_5min, l.has_next_station
          FROM model m JOIN labelled l USING (snapshot_id) LEFT JOIN boardings b ON b.station_id = m.station_id AND b.route_id = m.route_id AND b.day_of_week = m.day_of_week AND b.hour = m.hour
          WHERE l.has_next_station = 1""",
    "latest_rows": _OBS_BASE
    + "SELECT snapshot_id, collected_at_kst, station_seq, remain_seat_cnt FROM base WHERE canonical_route_name = '503A' AND remain_seat_cnt = 0 ORDER BY t DESC, snapshot_id DESC LIMIT 20",
    "data_coverage": _OBS_BASE
    + """SELECT count(*) AS total_rows, min(collected_at_kst) AS min_collected_at_kst, max(collected_at_kst) AS max_collected_at_kst,
         count(*) FILTER (collected_at_kst LIKE '2024-01-10%') AS requested_date_rows FROM base""",
    "null_profile": _OBS_BASE
    + """SELECT * FROM (
           SELECT 'station_name' AS "column", count(*) FILTER (station_name IS NULL) AS null_count FROM base UNION ALL SELECT 'mobile_no', count(*) FILTER (mobile_no IS NULL) FROM base
           UNION ALL SELECT 'x', count(*) FILTER (x IS NULL) FROM base UNION ALL SELECT 'y', count(*) FILTER (y IS NULL) FROM base
           UNION ALL SELECT 'estimated_capacity', count(*) FILTER (estimated_capacity IS NULL) FROM base UNION ALL SELECT 'crowded_label', count(*) FILTER (crowded_label IS NULL) FROM base
         ) WHERE null_count > 0""",
    "imputed_rates": _FEAT
    + """SELECT 'weather' AS feature_group, round_even(avg(weather_imputed), 4) AS imputed_rate FROM model UNION ALL SELECT 'airQuality', round_even(avg(air_quality_imputed), 4) FROM model
         UNION ALL SELECT 'traffic', round_even(avg(traffic_imputed), 4) FROM model UNION ALL SELECT 'event', round_even(avg(event_imputed), 4) FROM model""",
    "feature_recommendation": _FEAT
    + """, r AS (SELECT avg(weather_imputed) AS w, avg(air_quality_imputed) AS a, avg(traffic_imputed) AS t, avg(event_imputed) AS e FROM model)
         SELECT 'weather' AS feature_group, unnest(['temperature','precipitation','humidity','wind_speed','cloud_amount','weather_text']) AS feature, CASE WHEN w <= 0.30 THEN 1 ELSE 0 END AS recommended FROM r
         UNION ALL SELECT 'airQuality', unnest(['pm10','pm25','o3','khai','air_quality_grade']), CASE WHEN a <= 0.50 THEN 1 ELSE 0 END FROM r
         UNION ALL SELECT 'traffic', unnest(['avg_speed','traffic_volume','delay_time','congestion_level']), CASE WHEN t <= 0.50 THEN 1 ELSE 0 END FROM r
         UNION ALL SELECT 'event', unnest(['event_count','event_nearby_count']), CASE WHEN e <= 0.80 THEN 1 ELSE 0 END FROM r""",
    "route_rows": _OBS_BASE + "SELECT canonical_route_name, count(*) AS row_count FROM base GROUP BY ALL",
    "period_rows": _OBS_BASE + "SELECT time_period, count(*) AS row_count FROM base GROUP BY ALL",
    "seat_summary": _OBS_BASE
    + """SELECT service_date, day_name_ko, time_period, canonical_route_name, count(*) AS observation_count, CAST(round(CAST(avg(remain_seat_cnt) AS DECIMAL(20, 8)), 2) AS DOUBLE) AS avg_remain_seat_cnt,
         min(remain_seat_cnt) AS min_remain_seat_cnt, max(remain_seat_cnt) AS max_remain_seat_cnt, max(seat_scarcity_score) AS max_seat_scarcity_score,
         CAST(sum(is_no_seat) AS BIGINT) AS no_seat_count, CAST(sum(is_low_seat_2) AS BIGINT) AS low_seat_2_count, CAST(sum(is_low_seat_5) AS BIGINT) AS low_seat_5_count FROM base GROUP BY ALL""",
    "context_summary": _FEAT
    + """SELECT service_date, day_name_ko, time_period, canonical_route_name, count(*) AS observation_count, CAST(round(CAST(avg(remain_seat_cnt) AS DECIMAL(20, 8)), 2) AS DOUBLE) AS avg_remain_seat_cnt,
         CAST(round(CAST(avg(temperature) AS DECIMAL(20, 8)), 2) AS DOUBLE) AS avg_temperature, CAST(round(CAST(avg(precipitation) AS DECIMAL(20, 8)), 2) AS DOUBLE) AS avg_precipitation, CAST(round(CAST(avg(pm10) AS DECIMAL(20, 8)), 2) AS DOUBLE) AS avg_pm10, CAST(round(CAST(avg(avg_speed) AS DECIMAL(20, 8)), 2) AS DOUBLE) AS avg_traffic_speed,
         max(event_count) AS max_event_count, max(is_holiday) AS is_holiday, CAST(sum(weather_imputed) AS BIGINT) AS weather_imputed_count,
         CAST(sum(air_quality_imputed) AS BIGINT) AS air_quality_imputed_count, CAST(sum(traffic_imputed) AS BIGINT) AS traffic_imputed_count, CAST(sum(event_imputed) AS BIGINT) AS event_imputed_count
         FROM model GROUP BY ALL""",
    "route_station_count": f"""SELECT CAST(n.n_nationkey AS BIGINT) AS route_id, n.n_name AS route_name, replace(upper(n.n_name), ' ', '') AS canonical_route_name, count(p.station_id) AS station_count
         FROM nation n LEFT JOIN ({_SUPPLY_PAIRS}) p ON p.route_id = n.n_nationkey GROUP BY ALL""",
    "chrono_split": _OBS
    + f", r AS (SELECT snapshot_id, row_number() OVER (ORDER BY t, snapshot_id) AS rn, count(*) OVER () AS n FROM obs) SELECT snapshot_id, CASE WHEN rn <= {_TRAIN_SIZE} THEN 'train' ELSE 'test' END AS split FROM r",
    "three_way_split": _OBS
    + """, r AS (SELECT snapshot_id, row_number() OVER (ORDER BY t, snapshot_id) AS rn, count(*) OVER () AS n FROM obs),
         s AS (SELECT *, greatest(2, least(n - 1, floor(n * (1.0::DOUBLE - 0.2)))) AS pool FROM r)
         SELECT snapshot_id, CASE WHEN rn > pool THEN 'test' WHEN rn <= pool - greatest(1, floor(pool * 0.2)) THEN 'train' ELSE 'calibration' END AS split FROM s""",
    "route_split": _OBS
    + f""", r AS (SELECT snapshot_id, route_id, row_number() OVER (PARTITION BY route_id ORDER BY t, snapshot_id) AS rn, count(*) OVER (PARTITION BY route_id) AS n FROM obs)
         SELECT snapshot_id, route_id, CASE WHEN n < 2 THEN 'skipped' WHEN rn <= {_TRAIN_SIZE} THEN 'train' ELSE 'test' END AS split FROM r""",
    "route_split_counts": _OBS
    + f""", r AS (SELECT route_id, count(*) AS n, sum(CASE WHEN remain = 0 THEN 1 ELSE 0 END) AS p FROM obs GROUP BY ALL)
         SELECT route_id, n AS total_rows, CASE WHEN n < 2 THEN 0 ELSE CAST({_TRAIN_SIZE} AS BIGINT) END AS train_rows, CASE WHEN n < 2 THEN 0 ELSE CAST(n - {_TRAIN_SIZE} AS BIGINT) END AS test_rows,
         round_even(CAST(p AS DOUBLE) / n, 6) AS positive_rate, CASE WHEN n < 2 THEN 1 ELSE 0 END AS skipped FROM r""",
    "earliest_test_rows": _OBS
    + f""", r AS (SELECT snapshot_id, row_number() OVER (ORDER BY t, snapshot_id) AS rn, count(*) OVER () AS n FROM obs)
         SELECT snapshot_id FROM r WHERE rn > {_TRAIN_SIZE} AND rn <= {_TRAIN_SIZE} + ceil((n - {_TRAIN_SIZE}) / 2)""",
    "smoothed_rates": f"{_OBS_HIST},{_BASELINE}"
    + """ SELECT 'route_station_hour' AS level, route AS canonical_route_name, seq AS station_seq, hour, n AS rate_rows, round(p, 6) AS rate FROM r1
          UNION ALL SELECT 'route_station', route, seq, -1, n, round(p, 6) FROM r2 UNION ALL SELECT 'route_hour', route, -1, hour, n, round(p, 6) FROM r3
          UNION ALL SELECT 'hour', '-', -1, hour, n, round(p, 6) FROM r4 UNION ALL SELECT 'global', '-', -1, -1, n, round(p, 6) FROM r5""",
    "historical_baseline": f"{_OBS_HIST},{_BASELINE} SELECT row_id AS snapshot_id, round(probability, 6) AS probability, rate_level FROM scored",
    "baseline_metrics": f"{_OBS_HIST},{_BASELINE},{_confusion('scored', 0.3)},{_ranked('scored')} SELECT conf.*, auc.*, top.* FROM conf, auc, top",
    "proxy_stats": f"{_OBS_HIST},{_proxy('past', 'has_next = 1')}"
    + """ SELECT level, coalesce(route, '-') AS canonical_route_name, coalesce(station_id, '-') AS station_id, coalesce(seq, '-') AS station_seq, coalesce(hour, '-') AS hour,
          coalesce(we, '-') AS is_weekend, coalesce(ho, '-') AS is_holiday, CAST(historical_proxy_rows AS DOUBLE) AS historical_proxy_rows,
          coalesce(next_rate, -1.0) AS historical_next_station_full_rate, coalesce(now_rate, -1.0) AS historical_now_full_rate, CAST(coalesce(p_seats, -1) AS DOUBLE) AS proxy_remain_seat_cnt,
          CAST(coalesce(p_crowded, -1) AS DOUBLE) AS proxy_crowded, CAST(coalesce(p_cap, -1) AS DOUBLE) AS proxy_capacity FROM stats""",
    "proxy_fallback": f"{_OBS_HIST},{_proxy('past', 'y IS NOT NULL')},"
    + "probe AS (SELECT * REPLACE (station_id + CASE WHEN snapshot_id % 3 = 0 THEN 500 ELSE 0 END AS station_id) FROM fut),"
    + _fallback("probe")
    + f""", done AS (SELECT snapshot_id, coalesce(st.level, 'none') AS g, coalesce(st.historical_proxy_rows, 0) AS n, coalesce(st.next_rate, -1.0) AS rate, CAST(coalesce(nullif(st.p_cap, 0), cap) AS INTEGER) AS c,
          CAST(coalesce(st.p_seats, st.p_cap, cap) AS INTEGER) AS r, coalesce(st.p_crowded, 0) AS crowded FROM picked)
          SELECT snapshot_id, g AS historical_proxy_group, n AS historical_proxy_rows, {_CONFIDENCE} AS proxy_confidence, rate AS historical_next_station_full_rate, r AS remain_seat_cnt, crowded,
          c AS estimated_capacity, {_scarcity('r', 'c')} AS seat_scarcity_score, CASE WHEN r <= 2 THEN 1 ELSE 0 END AS is_low_seat_2 FROM done""",
    "confusion_metrics": f"{_OBS_PREDS},{_confusion('preds', 0.2)} SELECT * FROM conf",
    "group_metrics": f'{_OBS_PREDS},{_confusion("preds", 0.2, "grp")},{_ranked("preds", "grp")} SELECT conf.grp AS "group", conf.* EXCLUDE (grp), auc.roc_auc, top.top_decile_precision FROM conf JOIN auc USING (grp) JOIN top USING (grp)',
    "roc_auc": f"{_OBS_PREDS},{_ranked('preds')} SELECT * FROM auc",
    "top_decile": f"{_OBS_PREDS},{_ranked('preds')} SELECT * FROM top",
    "threshold_curve": f"{_OBS_PREDS},{_curve('preds', _T10)} SELECT * FROM curve",
    "calibration_bins": f"{_OBS_PREDS},{_BINS}"
    + """ SELECT CAST(i AS INTEGER) AS bin_index, printf('%.1f-%.1f', i / 10, (i + 1) / 10) AS bin, coalesce(n, 0) AS rows, coalesce(round_even(p, 6), 0.0) AS avg_predicted,
          coalesce(round_even(y, 6), 0.0) AS actual_rate, coalesce(round_even(abs(p - y), 6), 0.0) AS abs_error FROM range(10) r(i) LEFT JOIN bins ON b = i""",
    "calibration_error": f"{_OBS_PREDS},{_BINS} SELECT round_even(sum(abs(p - y) * n) / sum(n), 6) AS expected_calibration_error FROM bins",
    "segment_metrics": f"{_OBS_PREDS},{_SEGMENT},{_confusion('seg', 0.1, 'segment')},{_ranked('seg', 'segment')}"
    + """ SELECT conf.*, auc.roc_auc, top.top_decile_precision, CASE segment WHEN 'origin_0_25' THEN 0 WHEN 'early_mid_25_50' THEN 1 WHEN 'late_mid_50_75' THEN 2 WHEN 'terminal_75_100' THEN 3 ELSE 4 END AS segment_order
          FROM conf JOIN auc USING (segment) JOIN top USING (segment)""",
    "segment_thresholds": f"{_OBS_PREDS},{_SEGMENT},{_curve('seg', _T13, 'segment')},{_SEGMENT_BEST} SELECT * FROM segbest",
    "operating_policy": f"{_OBS_PREDS},{_SEGMENT},{_curve('seg', _T13, 'segment')},{_SEGMENT_BEST},"
    + _curve("preds", _T10).replace("curve0", "all0").replace("curve AS", "allc AS")
    + """ SELECT 0.9::DOUBLE AS default_threshold, 0.95::DOUBLE AS precision_mode_threshold, a.precision AS balanced_precision, a.recall AS balanced_recall, a.f1 AS balanced_f1, a.alert_rate AS balanced_alert_rate,
          b.precision AS precision_mode_precision, b.recall AS precision_mode_recall, (SELECT recommended_threshold FROM segbest WHERE segment = 'terminal_75_100') AS terminal_segment_threshold
          FROM allc a, allc b WHERE a.threshold = 0.9 AND b.threshold = 0.95""",
    "class_weights": f"{_OBS_PREDS}"
    + """ SELECT count(*) AS rows, CAST(sum(actual) AS BIGINT) AS positives, round(count(*) / (2.0 * sum(actual)), 6)::DOUBLE AS positive_weight,
          round(count(*) / (2.0 * (count(*) - sum(actual))), 6)::DOUBLE AS negative_weight FROM preds""",
    "platt_inputs": f"{_OBS_PREDS}"
    + """, z AS (SELECT row_id, ln(least(greatest(probability, 1e-6), 1 - 1e-6) / (1 - least(greatest(probability, 1e-6), 1 - 1e-6))) AS l FROM preds)
          SELECT row_id, round(l, 6) AS logit, round(1 / (1 + exp(-(2 * l - 1))), 6) AS rescaled FROM z""",
    "top_risk_samples": f"{_OBS_PREDS} SELECT row_id, probability, actual FROM preds ORDER BY probability DESC, t, row_id LIMIT 20",
    "missed_samples": f"{_OBS_PREDS} SELECT row_id, probability, actual FROM preds WHERE actual = 1 AND probability < 0.5 ORDER BY probability, t, row_id LIMIT 20",
    "score_projection": f"{_OBS_PREDS},{_SEGMENT}"
    + """ SELECT row_id AS "snapshotId", segment AS "stationSeqSegment", round_even(probability, 6) AS "fullSeatProbability", round_even(probability * 100, 2) AS "fullSeatRiskScore",
          CASE WHEN probability >= 0.9 THEN 1 ELSE 0 END AS "isFullRisk",
          CASE WHEN probability >= 0.9 THEN 'high' WHEN probability >= 0.7 THEN 'watch' WHEN probability >= 0.4 THEN 'medium' ELSE 'low' END AS "riskLevel" FROM seg""",
    "canonical_route": "SELECT c_custkey, upper(c_mktsegment) || '-' || (c_custkey % 9) || 'B-X' AS canonical FROM customer",
    "target_route_filter": """
      WITH items AS (SELECT c_custkey, '50' || printf('%02d', c_custkey % 7) || (['(A)', '(b)', '-1(a)', '', 'C'])[c_custkey % 5 + 1] AS route_name,
                            CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS region FROM customer)
      SELECT * FROM items WHERE replace(replace(upper(route_name), '(', ''), ')', '') IN ('5000','5001A','5001B','5001-1A','5001-1B','5003A','5003B','5005') AND (region = '' OR contains(region, 'BUILD'))""",
    "kst_parse": """
      WITH x AS (SELECT o_orderkey AS k, make_timestamp(epoch_us(o_orderdate) + (o_orderkey * 3607 % 86400) * 1000000) AS u FROM orders),
      y AS (SELECT k, CASE k % 8 WHEN 0 THEN u WHEN 1 THEN date_trunc('minute', u) WHEN 2 THEN date_trunc('day', u) WHEN 3 THEN date_trunc('hour', u) WHEN 4 THEN date_trunc('minute', u)
                   WHEN 5 THEN u + INTERVAL 9 HOUR WHEN 6 THEN u END AS wall FROM x)
      SELECT k AS o_orderkey, coalesce(strftime(wall, '%Y-%m-%dT%H:%M:%S') || '+09:00', 'none') AS kst, coalesce(epoch_us(wall) // 1000000 - 32400, -1) AS epoch,
             coalesce(CAST(CAST(wall AS DATE) AS VARCHAR), 'none') AS service_date FROM y""",
    "forecast_grid": """
      WITH p AS (SELECT s_suppkey, (s_suppkey * 0.013::DOUBLE) % 5 + 125.2::DOUBLE AS lon, (s_suppkey * 0.017::DOUBLE) % 4.5::DOUBLE + 33.6::DOUBLE AS lat FROM supplier),
      c AS (SELECT ln(cos(radians(30)) / cos(radians(60))) / ln(tan(radians(60)) / tan(radians(45 + 15))) AS bad),
      k AS (SELECT ln(cos(radians(30)) / cos(radians(60))) / ln(tan(pi() / 4 + radians(60) / 2) / tan(pi() / 4 + radians(30) / 2)) AS sn),
      s AS (SELECT sn, 6371.00877::DOUBLE / 5 * power(tan(pi() / 4 + radians(30) / 2), sn) * cos(radians(30)) / sn AS f FROM k),
      r AS (SELECT p.s_suppkey, s.f / power(tan(pi() / 4 + radians(lat) / 2), sn) AS ra, radians(lon - 126) * sn AS theta, s.f / power(tan(pi() / 4 + radians(38) / 2), sn) AS ro FROM p, s)
      SELECT s_suppkey, CAST(trunc(ra * sin(theta) + 43.5) AS INTEGER) AS nx, CAST(trunc(ro - ra * cos(theta) + 136.5) AS INTEGER) AS ny FROM r""",
    "scarcity": _OBS
    + f""", c AS (SELECT *, CASE WHEN veh_id % 4 <> 0 THEN CAST(veh_id % 30 + 20 AS INTEGER) END AS cap FROM obs)
         SELECT snapshot_id, {_scarcity('remain', 'coalesce(cap, 45)')} AS seat_scarcity_score, coalesce(cap, CASE WHEN rtype = 11 THEN 45 END, -1) AS capacity, coalesce({_CROWDED}, 'unknown') AS crowded_label FROM c""",
    "sql_functions": _OBS
    + f""", c AS (SELECT snapshot_id, ts AS wall, remain, station_seq, crowded, plate_no FROM obs)
         SELECT snapshot_id, {_PERIOD} AS period, {_scarcity('remain', '40')} AS score,
         CASE WHEN station_seq <= 0 THEN 'unknown' WHEN station_seq / 99 <= 0.25 THEN 'origin_0_25' WHEN station_seq / 99 <= 0.5 THEN 'early_mid_25_50' WHEN station_seq / 99 <= 0.75 THEN 'late_mid_50_75' ELSE 'terminal_75_100' END AS segment,
         CASE WHEN remain / 50 >= 0.9 THEN 'high' WHEN remain / 50 >= 0.7 THEN 'watch' WHEN remain / 50 >= 0.4 THEN 'medium' ELSE 'low' END AS level,
         CASE WHEN crowded > 2 THEN 'rain' WHEN station_seq % 10 >= 8 THEN 'cloudy' WHEN station_seq % 10 >= 3 THEN 'partly_cloudy' ELSE 'clear' END AS weather, plate_no || 'A' AS name FROM c""",
    "safe_numbers": """
      WITH x AS (SELECT o_orderkey AS k FROM orders)
      SELECT k AS o_orderkey, CASE WHEN k % 5 = 1 THEN k ELSE -1 END AS strict, CASE WHEN k % 5 IN (0, 1) THEN k ELSE -1 END AS loose,
             CASE WHEN k % 5 IN (0, 1) THEN k WHEN k % 5 = 2 THEN 1000 + k % 1000 ELSE -1 END AS comma,
             CASE WHEN k % 5 = 0 THEN CAST(k || '.7' AS DOUBLE) WHEN k % 5 = 1 THEN CAST(k AS DOUBLE) ELSE 0.5 END AS number,
             CASE k % 5 WHEN 0 THEN k || '.7' WHEN 1 THEN ' ' || k || ' ' WHEN 2 THEN '1,' || printf('%03d', k % 1000) WHEN 3 THEN '-' ELSE 'unknown' END AS text FROM x""",
    "cyclic_time": _OBS
    + """, c AS (SELECT CAST(isodow(wall) - 1 AS INTEGER) AS day_of_week, CAST(hour(wall) AS INTEGER) AS hour, count(*) AS rows FROM obs GROUP BY ALL)
         SELECT *, round(sin(2 * pi() * hour / 24), 6) AS hour_sin, round(cos(2 * pi() * hour / 24), 6) AS hour_cos, round(sin(2 * pi() * day_of_week / 7), 6) AS day_sin, round(cos(2 * pi() * day_of_week / 7), 6) AS day_cos FROM c""",
    "json_envelope": _OBS
    + """SELECT event_id, user_id % 8 AS route_id, CAST(k AS BIGINT) AS station_seq, 'item' AS kind FROM ev, range(2) c(c) WHERE event_id % 10 < 8 AND (c = 0 OR event_id % 3 = 0)
         UNION ALL SELECT event_id, -1, -1, '22' FROM ev WHERE event_id % 10 = 9""",
    "json_props": "SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS k FROM events",
    "location_ingest": _OBS
    + """SELECT route_id, 11 AS route_type_cd, 1 AS low_plate, count(*) AS rows, count(*) FILTER (snapshot_id % 11 <> 0) AS with_vehicle, count(*) FILTER (snapshot_id % 13 <> 0) AS with_plate, 0::BIGINT AS with_station,
         count(*) FILTER (snapshot_id % 7 <> 0) AS with_seats, CAST(sum(remain) FILTER (snapshot_id % 7 <> 0) AS BIGINT) AS seats, CAST(sum(station_seq) AS BIGINT) AS stops, 0::BIGINT AS with_state, count(*) AS with_raw
         FROM obs GROUP BY route_id""",
    "dedup_new_rows": _OBS
    + """, b AS (SELECT DISTINCT route_id, station_seq, coalesce(nullif(remain, 0), -1) AS remain_seat_cnt FROM obs),
         k AS (SELECT DISTINCT route_id, station_seq, coalesce(nullif(remain, 0), -1) AS remain_seat_cnt FROM obs WHERE snapshot_id % 3 = 0)
         SELECT * FROM b EXCEPT SELECT * FROM k""",
    "import_outcomes": _OBS
    + """, k AS (SELECT DISTINCT route_id, station_seq, remain FROM obs WHERE snapshot_id % 5 = 0),
         t AS (SELECT o.snapshot_id, CASE WHEN o.route_id = 7 THEN 'non_target' WHEN k.route_id IS NOT NULL OR row_number() OVER (PARTITION BY o.route_id, o.station_seq, o.remain ORDER BY o.snapshot_id) > 1 THEN 'existing' ELSE 'imported' END AS outcome
               FROM obs o LEFT JOIN k ON k.route_id = o.route_id AND k.station_seq = o.station_seq AND k.remain = o.remain)
         SELECT outcome, count(*) AS rows, min(snapshot_id) AS first_id FROM t GROUP BY ALL""",
    "upsert_latest": _OBS
    + """, x AS (SELECT veh_id, route_id, snapshot_id, remain AS remain_seat_cnt FROM obs),
         o AS (SELECT * FROM x WHERE snapshot_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY veh_id, route_id ORDER BY snapshot_id DESC) = 1),
         n AS (SELECT * FROM x WHERE snapshot_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY veh_id, route_id ORDER BY snapshot_id DESC) = 1)
         SELECT * FROM n UNION ALL SELECT * FROM o WHERE (veh_id, route_id) NOT IN (SELECT (veh_id, route_id) FROM n)""",
    "missing_names": _OBS + "SELECT DISTINCT CAST(n_nationkey % 12 AS BIGINT) AS route_id FROM nation WHERE n_nationkey % 12 NOT IN (SELECT route_id FROM obs)",
    "merge_detail": """SELECT c.c_custkey AS id, CASE WHEN s.s_suppkey % 2 = 0 THEN s.s_name ELSE c.c_name END AS name, c.c_mktsegment AS kind, coalesce(s.s_nationkey, -1) AS nation
         FROM customer c LEFT JOIN supplier s ON s.s_suppkey * 3 = c.c_custkey""",
    "route_audit": f"WITH {_EVENTS},{_DIMS} "
    + """SELECT r.route_id, coalesce((SELECT count(*) FROM stops s WHERE s.route_id = r.route_id AND s.route_id <> 2), 0) AS station_count,
         CASE WHEN r.route_id = 5 THEN 0 ELSE r.n END AS location_count, CASE WHEN r.route_id = 5 THEN 0 ELSE 1 END AS has_remain_seat_cnt,
         CASE WHEN r.route_id IN (3, 5) THEN 0 ELSE 1 END AS has_crowded, CASE WHEN r.route_id = 5 THEN 0 ELSE 1 END AS has_station_seq
         FROM (SELECT route_id, count(*) AS n FROM obs GROUP BY ALL) r""",
    "tumbling_10m": _OBS + "SELECT route_id, t // 600000000 * 600 AS bucket, count(*) AS rows FROM obs GROUP BY ALL",
    "arrival_unpivot": f"WITH {_ARRIVALS} SELECT request_id, arrival_slot, plate_no, coalesce(veh_id, -1) AS veh_id, predict_time, coalesce(remain_seat_cnt, -1) AS remain_seat_cnt FROM slots",
    "arrival_diagnostics": f"WITH {_ARRIVALS} SELECT (SELECT count(*) FROM arr) AS arrivals, (SELECT count(*) FROM slots) AS arrival_candidate_slots, 'arrival_vehicle_fields_present' AS empty_reason",
    "arrival_filter": f"WITH {_ARRIVALS} SELECT request_id, route_id FROM arr WHERE route_id = 3",
    "position_match": f"WITH {_EVENTS},{_ARRIVALS},{_MATCHED} SELECT request_id, arrival_slot, CASE WHEN m_veh IS NULL THEN 0 ELSE 1 END AS matched, coalesce(m_seq, -1) AS station_seq, coalesce(m_remain, -1) AS remain_seat_cnt FROM matched",
    "stop_metadata": f"WITH {_EVENTS},{_DIMS},{_ARRIVALS},{_STOP_BY_ID} "
    + """SELECT a.request_id, coalesce(r.canonical_route_name, '50' || a.route_id || 'A') AS canonical_route_name, coalesce(r.route_type_name, 'unknown') AS route_type_name,
         coalesce(q.station_name, i.station_name, 'unknown') AS station_name, coalesce(q.mobile_no, i.mobile_no, 'unknown') AS mobile_no, round(coalesce(q.x, i.x, 0.0), 4)::DOUBLE AS x, coalesce(q.dir, i.dir, '-') AS station_direction
         FROM arr a LEFT JOIN routes r ON r.route_id = a.route_id LEFT JOIN stops q ON q.route_id = a.route_id AND q.station_seq = a.sta_order LEFT JOIN by_id i ON i.route_id = a.route_id AND i.station_id = a.station_id""",
    "timetable": f"WITH {_timetable()} SELECT route_id, direction, day_type, coalesce(first, '-') AS first, coalesce(last, '-') AS last, peak, off_peak FROM timetable",
    "schedule_context": f"WITH {_EVENTS},{_DAYS},{_timetable()},req AS (SELECT o_orderkey AS request_id, o_custkey % 12 AS route_id, (1704067200 + o_orderkey * 1777 % 2592000) * 1000000 AS at_us, CASE WHEN o_orderkey % 2 = 0 THEN 'up' ELSE 'down' END AS direction FROM orders),{_CONTEXT}"
    + """ SELECT request_id, CAST(service_date AS VARCHAR) AS schedule_service_date, day_type AS schedule_day_type, coalesce(first, '-') AS schedule_first_time, coalesce(last, '-') AS schedule_last_time,
          coalesce(CASE WHEN phour IN (7, 8, 9, 17, 18, 19, 20) THEN peak ELSE off_peak END, -1) AS schedule_allocation_minutes, CASE WHEN operating THEN 1 ELSE 0 END AS scheduled_operating,
          coalesce(strftime(make_timestamp(proxy_wall), '%Y-%m-%dT%H:%M:%S') || '+09:00', '-') AS schedule_proxy_at_kst, CASE WHEN operating THEN 'requested_time' ELSE 'next_first_time' END AS schedule_proxy_time_basis FROM sched""",
    "live_rows": f"WITH {_LIVE_CTES} "
    + f"""SELECT request_id, arrival_slot, l_veh AS veh_id, plate_no, l_station AS station_id, l_seq AS station_seq, station_name, requested_station_name, l_remain AS remain_seat_cnt, l_crowded AS crowded,
          CASE l_crowded WHEN 1 THEN '여유' WHEN 2 THEN '보통' WHEN 3 THEN '혼잡' WHEN 4 THEN '매우혼잡' ELSE 'unknown' END AS crowded_label, l_cap AS estimated_capacity,
          CASE WHEN l_remain < 0 THEN 0 ELSE {_scarcity('l_remain', 'l_cap')} END AS seat_scarcity_score, CASE WHEN l_remain = 0 THEN 1 ELSE 0 END AS is_no_seat, CASE WHEN l_remain BETWEEN 0 AND 5 THEN 1 ELSE 0 END AS is_low_seat_5,
          CASE WHEN m_veh IS NULL THEN 0 ELSE 1 END AS matched_location, CASE WHEN m_veh IS NULL THEN 'arrival_only' ELSE 'position_match' END AS feature_source, canonical_route_name, CAST(hour(wall) AS INTEGER) AS hour,
          printf('%02d:%02d', hour(wall), minute(wall) // 10 * 10) AS time_bucket_10m FROM live1""",
    "scheduled_rows": f"WITH {_SCHEDULED_CTES}"
    + f""", done AS (SELECT p.*, coalesce(st.level, 'none') AS g, coalesce(st.historical_proxy_rows, 0) AS n, CAST(coalesce(st.p_cap, nullif(c.cap, 0), 45) AS INTEGER) AS c, coalesce(st.p_crowded, 0) AS crowded, st.p_seats AS ps FROM picked p LEFT JOIN rcaps c ON c.route_id = p.route_id)
          SELECT request_id, route_id, station_id, coalesce(seq, 0) AS station_seq, direction AS schedule_direction, CASE WHEN operating THEN 'requested_time' ELSE 'next_first_time' END AS schedule_proxy_time_basis,
          strftime(pw, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS collected_at_kst, g AS historical_proxy_group, n AS historical_proxy_rows, CAST(coalesce(ps, c) AS INTEGER) AS remain_seat_cnt, crowded, c AS estimated_capacity,
          {_scarcity('coalesce(ps, c)', 'c')} AS seat_scarcity_score, station_name FROM done""",
    "live_or_proxy": f"WITH {_ARRIVALS} "
    + """SELECT a.request_id, CASE WHEN a.request_id % 17 = 0 THEN 'none' WHEN n > 0 THEN 'live_vehicle' ELSE 'schedule_prior' END AS prediction_mode,
         CASE WHEN a.request_id % 17 = 0 THEN 1 ELSE coalesce(n, 1) END AS rows
         FROM arr a LEFT JOIN (SELECT request_id, count(*) AS n FROM slots GROUP BY ALL) s USING (request_id)""",
    "route_requests": _OBS
    + """, q AS (SELECT c_custkey AS k, c_custkey % 50 AS station_id FROM customer)
         SELECT k AS request_id, k % 9 AS route_id, CAST(k % 9 AS VARCHAR) AS route_name, station_id FROM q WHERE k % 3 = 0
         UNION ALL SELECT k, r.route_id, '50' || (k % 10) || '(a)', station_id FROM q JOIN (SELECT DISTINCT route_id FROM obs WHERE route_id <> 7) r ON r.route_id = k % 10 WHERE k % 3 = 1""",
    "baseline_evaluation": f"WITH {_EVENTS},{_DIMS},{_BASE},{_LABELS},"
    + f"""hist AS (SELECT b.snapshot_id, b.t, b.canonical_route_name AS route, b.station_seq AS seq, b.hour, l.target_no_seat_next_station AS y,
            row_number() OVER (ORDER BY b.t, b.snapshot_id) AS rn, count(*) OVER () AS n FROM base b JOIN labelled l USING (snapshot_id) WHERE l.has_next_station = 1),
         past AS (SELECT * FROM hist WHERE rn <= {_TRAIN_SIZE}), fut AS (SELECT * FROM hist WHERE rn > {_TRAIN_SIZE}),
         {_BASELINE},{_confusion('scored', 0.5)},{_ranked('scored')}
         SELECT 'target_no_seat_next_station' AS target_column, (SELECT count(*) FROM hist) AS total_rows, (SELECT count(*) FROM past) AS train_rows, (SELECT count(*) FROM fut) AS test_rows,
         (SELECT round_even(avg(y), 6) FROM hist) AS positive_rate, conf.accuracy, conf.precision, conf.recall, conf.f1, conf.brier_score, auc.roc_auc, top.top_decile_precision,
         'time_split_historical_rate_with_laplace_smoothing:route_station_hour->route_station->route_hour->hour->global' AS strategy FROM conf, auc, top""",
}

ORACLES["logistic_certificate"] = ORACLES["baseline_evaluation"].split("fut AS")[0] + f"""one AS (SELECT 1)
         SELECT count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, CAST(count(*) AS DOUBLE) AS weight, 1 AS optimal, 1 AS better_than_none FROM past"""
#: The same optimum by Newton's method: 40 steps from zero, halved where they would be long.
ORACLES["platt_fit"] = (
    _OBS_PREDS.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", g AS (SELECT ln(least(greatest(probability, 1e-6), 1 - 1e-6) / (1 - least(greatest(probability, 1e-6), 1 - 1e-6))) AS l, sum(actual)::DOUBLE AS y, count(*)::DOUBLE AS n FROM preds GROUP BY 1),
         fit AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
           SELECT i + 1, a - k * (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - k * (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
             SELECT i, a, b, CASE WHEN i < 8 THEN 0.5 ELSE 1.0 END AS k, sum((n * p - y) * l) / sum(n) + 0.001 * a AS g1, sum(n * p - y) / sum(n) AS g2,
                    sum(n * p * (1 - p) * l * l) / sum(n) + 0.001 AS h11, sum(n * p * (1 - p) * l) / sum(n) AS h12, sum(n * p * (1 - p)) / sum(n) AS h22
             FROM (SELECT i, a, b, l, y, n, 1 / (1 + exp(-(a * l + b))) AS p FROM fit, g WHERE i < 40) GROUP BY i, a, b))
         SELECT round(a, 3) AS a, round(b, 3) AS b FROM fit WHERE i = 40"""
)
ORACLES["dump_rows"] = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN 'it''s (' || o_orderpriority || '),(' || chr(92) || ' '');' || chr(10) || '(' || o_orderstatus ELSE '-' END AS note,
         o_custkey AS rider FROM orders"""

#: Results from merged parts are those of all rows.
for _merged, _whole in {
    "vehicles_merged": "vehicles_per_hour", "boardings_merged": "expected_boardings", "rates_merged": "smoothed_rates", "proxy_merged": "proxy_stats",
    "auc_merged": "roc_auc", "curve_merged": "threshold_curve", "bins_merged": "calibration_bins",
}.items():
    ORACLES[_merged] = ORACLES[_whole]
