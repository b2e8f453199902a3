"""A city of eight routes and five stops for two days: inputs whose results are known."""

from pyspark.sql import SparkSession, functions as F

from kerbline.functions import seats, text
from kerbline.sources import context

# The sample city.
ROUTES = [
    (5000001, "5000"), (5001001, "5001(A)"), (5001002, "5001(B)"), (5001100, "5001-1(A)"), (5001101, "5001-1(B)"),
    (5003001, "5003(A)"), (5003002, "5003(B)"), (5005001, "5005"),
]
STOPS = [228000101 + i for i in range(6)]
POLLS = ["2026-05-20T22:50:00+00:00", "2026-05-20T23:10:00+00:00", "2026-05-21T08:30:00+00:00"]
SEATS = [[18, 9, 4, 2, 0], [15, 6, 3, 1, 0], [22, 12, 7, 4, 2]]
LATE_POLL = "2026-05-21T16:20:00+00:00"
BOARDINGS = [1850, 1240, 980, 1460, 1320, 2100]
WEATHER = [
    ("119", "2026-05-21 07:00", "15.8", "0", "62", "1.8", "2"), ("119", "2026-05-21 08:00", "17.1", "0", "58", "2.1", "4"),
    ("119", "2026-05-21 17:00", "22.4", "1.2", "72", "3.4", "9"), ("119", "2026-05-22 01:00", "13.6", "0", "66", "1.0", "1"),
]
AIR = [("07", 38, 18, 0.031, 62), ("08", 42, 20, 0.034, 67), ("17", 56, 31, 0.041, 82)]
TRAFFIC = [("07", 41.5, 820, 6.0, 2), ("08", 28.2, 1140, 13.5, 4), ("17", 24.7, 1310, 18.0, 4)]


def tables(spark: SparkSession) -> dict:
    shots, n = [], 0
    for i, at in enumerate(POLLS):
        for r, (route, _) in enumerate(ROUTES):
            for s in range(5):
                n += 1
                shots.append((n, at, route, route + i, f"70-{r + 1}{i + 1:02d}", STOPS[s], s + 1, max(0, SEATS[i][s] - r)))
    for r, (route, _) in enumerate(ROUTES):
        n += 1
        shots.append((n, LATE_POLL, route, route + 99, f"70-{r + 1}99", STOPS[1], 2, 35 - r))
    snapshots = spark.createDataFrame(
        shots, "snapshot_id BIGINT, at STRING, route_id BIGINT, veh_id BIGINT, plate_no STRING, station_id BIGINT, station_seq INT, remain_seat_cnt INT"
    )
    snapshots = snapshots.select(
        "snapshot_id", F.col("at").cast("timestamp").alias("collected_at"), "route_id", "veh_id", "plate_no", "station_id", "station_seq",
        "remain_seat_cnt", seats.crowding_from_seats(F.col("remain_seat_cnt")).alias("crowded"), F.lit(11).alias("route_type_cd"),
        F.lit(0).alias("low_plate"), F.lit(1).alias("state_cd"), F.lit(0).alias("tagless_cd"), F.lit("{}").alias("raw_json"),
    )
    routes = spark.createDataFrame(ROUTES, "route_id BIGINT, route_name STRING").withColumns(
        {"canonical_route_name": text.canonical_route(F.col("route_name")), "route_type_cd": F.lit(11), "route_type_name": F.lit("express")}
    )
    stops = spark.createDataFrame(
        [(r, s + 1, STOPS[s], f"stop {s + 1}", f"M{s}", 127.0, 37.0, '{"direction":"UP"}') for r, _ in ROUTES for s in range(6)],
        "route_id BIGINT, station_seq INT, station_id BIGINT, station_name STRING, mobile_no STRING, x DOUBLE, y DOUBLE, raw_json STRING",
    )
    demand = spark.createDataFrame(
        [(d, STOPS[s], BOARDINGS[s] + 80 * i) for i, d in enumerate(("2026-05-20", "2026-05-21")) for s in range(6)],
        "service_date STRING, station_id BIGINT, boarding_total INT",
    ).withColumn("service_date", F.col("service_date").cast("date"))
    source = F.lit("sample")
    weather = spark.createDataFrame(WEATHER, "stnId STRING, tm STRING, ta STRING, rn STRING, hm STRING, ws STRING, dc10Tca STRING")
    air = spark.createDataFrame(
        [("yongin", f"2026-05-21T{h}:00:00+09:00", float(a), float(b), c, float(d)) for h, a, b, c, d in AIR],
        "air_station_name STRING, observed_at_kst STRING, pm10 DOUBLE, pm25 DOUBLE, o3 DOUBLE, khai DOUBLE",
    )
    traffic = spark.createDataFrame(
        [("corridor", f"2026-05-21T{h}:00:00+09:00", a, float(b), c, d) for h, a, b, c, d in TRAFFIC],
        "traffic_context_key STRING, observed_at_kst STRING, avg_speed DOUBLE, traffic_volume DOUBLE, delay_time DOUBLE, congestion_level INT",
    )
    holidays = spark.createDataFrame([("2026-05-21", 0, ""), ("2026-05-22", 0, "")], "service_date STRING, is_holiday INT, holiday_name STRING")
    events = spark.createDataFrame(
        [("global", "2026-05-21", 2, 1), ("global", "2026-05-22", 0, 0)], "area_key STRING, service_date STRING, event_count INT, event_nearby_count INT"
    )
    return {
        "snapshots": snapshots, "routes": routes, "stops": stops, "demand": demand,
        "weather": context.weather(weather, source), "air": context.air(air, source), "traffic": context.traffic(traffic, source),
        "holidays": context.holidays(holidays, source), "events": context.events(events, source),
    }
