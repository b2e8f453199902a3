"""The given tables seen as transit data.

``events`` become position snapshots of vehicles (users) on eight routes, ``lineitem`` daily stop demand, ``orders``
event spans and arrivals. Vehicles report hours apart there, so the queries use horizons of hours, not minutes.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.functions import seats
from kerbline.operators import demand as demand_ops, features, labels, training

HORIZONS = (("5min", 6 * 3600), ("10min", 12 * 3600))
NEXT_STOP_SECONDS = 24 * 3600
SLICE_SECONDS = 48 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position snapshots: seats from the value, stop from the property."""
    rows = table(spark, sf_dir, "events")
    stop = F.get_json_object("props", "$.k").cast("int")
    remain = F.floor(F.col("value") / 10).cast("int")
    route = F.col("user_id") % 8
    return rows.select(
        F.col("event_id").alias("snapshot_id"),
        F.col("ts").cast("timestamp").alias("collected_at"),
        route.alias("route_id"),
        F.col("user_id").alias("veh_id"),
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("plate_no"),
        (stop + 1000).cast("bigint").alias("station_id"),
        stop.alias("station_seq"),
        remain.alias("remain_seat_cnt"),
        seats.crowding_from_seats(remain).alias("crowded"),
        F.when(route < 4, 11).when(route == 4, 13).cast("int").alias("route_type_cd"),
        F.lit(1).alias("low_plate"),
        F.lit(2).alias("state_cd"),
        F.lit(0).alias("tagless_cd"),
        F.col("props").alias("raw_json"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes seen in the snapshots; number 7 is not one of ours."""
    ids = snapshots(spark, sf_dir).select("route_id").distinct().where("route_id <> 7")
    name = F.concat(F.lit("50"), F.col("route_id").cast("string"))
    return ids.select(
        "route_id",
        F.concat(name, F.lit("(a)")).alias("route_name"),
        F.concat(name, F.lit("A")).alias("canonical_route_name"),
        F.lit(11).alias("route_type_cd"),
        F.concat(F.lit("type "), F.col("route_id").cast("string")).alias("route_type_name"),
    )


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops seen in the snapshots; every tenth has no record."""
    pairs = snapshots(spark, sf_dir).select("route_id", "station_seq", "station_id").distinct().where("station_seq % 10 <> 0")
    seq = F.col("station_seq")
    return pairs.select(
        "route_id",
        "station_seq",
        "station_id",
        F.concat(F.lit("stop "), seq.cast("string")).alias("station_name"),
        F.concat(F.lit("M"), seq.cast("string")).alias("mobile_no"),
        (seq / 100 + 126.5).alias("x"),
        (seq / 100 + 37.0).alias("y"),
        F.format_string('{"direction":"%s"}', F.when(seq < 50, "상행").otherwise("D")).alias("raw_json"),
    )


def hourly_context(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Context of every ninth hour, so that some hours lie too far off: errors are weather, views air, clicks traffic."""
    ninth = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (9 * 3600)) * 9 * 3600
    rows = table(spark, sf_dir, "events").withColumn("observed_at", F.timestamp_seconds(ninth))

    def of(kind, key):
        return rows.where(F.col("event_type") == kind).groupBy((F.col("user_id") % 3).cast("string").alias(key), "observed_at")

    weather = of("error", "weather_station_id").agg(
        F.max("value").alias("temperature"),
        F.min("value").alias("precipitation"),
        F.count(F.lit(1)).cast("double").alias("humidity"),
        F.max("user_id").cast("double").alias("wind_speed"),
        F.min("user_id").cast("double").alias("cloud_amount"),
    )
    weather = weather.withColumn("weather_text", seats.weather_text(F.col("precipitation") - 10, F.col("cloud_amount") % 10))
    air = of("view", "air_station_name").agg(
        *[F.max("value").alias(c) for c in ("pm10", "o3")], *[F.min("value").alias(c) for c in ("pm25", "khai")]
    )
    air = air.withColumn("air_quality_grade", F.when(F.col("khai") > 10, "bad").otherwise("good"))
    traffic = of("click", "traffic_context_key").agg(
        F.max("value").alias("avg_speed"),
        F.min("value").alias("traffic_volume"),
        F.max("user_id").cast("double").alias("delay_time"),
        F.count(F.lit(1)).cast("int").alias("congestion_level"),
    )
    return {"weather": weather, "air": air, "traffic": traffic}


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which some signup was worth more than 300 are holidays; a day listed with 0 is not."""
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'")
    day = F.to_date(F.col("ts"))
    return rows.groupBy(day.alias("service_date")).agg(
        (F.max("value") > 300).cast("int").alias("is_holiday"), F.concat(F.lit("day "), F.max("user_id").cast("string")).alias("holiday_name")
    )


def day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area events per day from purchases."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.groupBy(F.concat(F.lit("area"), (F.col("user_id") % 4).cast("string")).alias("area_key"), F.to_date("ts").alias("service_date")).agg(
        F.count(F.lit(1)).cast("int").alias("event_count"), F.countDistinct("user_id").cast("int").alias("event_nearby_count")
    )


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily boardings per stop: a supplier's shipped quantity per day."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("service_date")).agg(
        F.sum("l_quantity").alias("boarding_total")
    )


def route_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("station_id"), (F.col("l_partkey") % 8).alias("route_id")).distinct()


def base_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.location_features(snapshots(spark, sf_dir), routes(spark, sf_dir), stops(spark, sf_dir))


def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = hourly_context(spark, sf_dir)
    return features.model_features(
        base_features(spark, sf_dir),
        context["weather"],
        context["air"],
        context["traffic"],
        holidays(spark, sf_dir),
        day_events(spark, sf_dir),
    )


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What labelling needs: the vehicle series and seat flags."""
    rows = snapshots(spark, sf_dir)
    return rows.select(
        "snapshot_id", "collected_at", "route_id", "veh_id", "plate_no", "station_seq",
        *[c.alias(n) for n, c in seats.seat_flags(F.col("remain_seat_cnt")).items()],
    )


def label_table(rows: DataFrame) -> DataFrame:
    return labels.label_table(
        rows,
        micros=F.unix_micros("collected_at"),
        horizons=HORIZONS,
        next_stop_seconds=NEXT_STOP_SECONDS,
        slice_seconds=SLICE_SECONDS,
    )


def training_set(spark: SparkSession, sf_dir: str, target: str | None = None) -> DataFrame:
    feats = model_features(spark, sf_dir)
    boardings = demand_ops.expected_boardings(boarding_stations(spark, sf_dir), stops(spark, sf_dir), base_features(spark, sf_dir))
    return training.training_set(feats, label_table(label_rows(spark, sf_dir)), boardings, target)


def boarding_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand keyed like the snapshot stops: supplier 1..100 is stop 1001..1100."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy((F.col("l_suppkey") % 90 + 1001).alias("station_id"), F.to_date("l_shipdate").alias("service_date")).agg(
        F.sum("l_quantity").alias("boarding_total")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: score from the value, label from the property."""
    rows = table(spark, sf_dir, "events")
    stop = F.get_json_object("props", "$.k").cast("int")
    return rows.select(
        F.col("event_id").alias("row_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        (F.floor("value") / 500.0).alias("probability"),
        ((stop < 30) | (F.col("value") > 150)).cast("int").alias("actual"),
        F.col("event_type").alias("grp"),
        (F.col("user_id") % 8).cast("string").alias("canonical_route_name"),
        stop.alias("station_seq"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival rows from orders: two vehicle slots, some empty."""
    rows = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def slot(n, shift):
        there = (key + shift) % 3 != 0
        vehicle = (cust + shift) % 200
        return [
            F.when(there, F.concat(F.lit("P"), vehicle.cast("string"))).alias(f"plate_no{n}"),
            F.when(there & (key % 5 != 0), vehicle).alias(f"veh_id{n}"),
            F.when(there, (key % 30).cast("int")).alias(f"predict_time{n}"),
            F.when(there, (key % 1800).cast("int")).alias(f"predict_time_sec{n}"),
            F.when(there & (key % 7 != 0), ((key + shift) % 46).cast("int")).alias(f"remain_seat_cnt{n}"),
            F.when(there & (key % 4 != 0), ((key % 4) + 1).cast("int")).alias(f"crowded{n}"),
        ]

    return rows.select(
        key.alias("request_id"),
        (key % 100 + 1000).alias("requested_station_id"),
        (key % 100 + 1000).alias("station_id"),
        F.expr("timestamp'2024-01-10 00:00:00'").alias("_base"),
        (cust % 10).alias("route_id"),
        F.concat(F.lit("50"), (cust % 10).cast("string"), F.lit("(a)")).alias("route_name"),
        F.lit(11).alias("route_type_cd"),
        F.when(key % 6 != 0, (key % 100).cast("int")).alias("sta_order"),
        F.lit(40).alias("turn_seq"),
        F.lit("PASS").alias("flag"),
        *slot(1, 0),
        *slot(2, 1),
    ).withColumn("collected_at", F.timestamp_seconds(F.unix_seconds("_base") + F.col("request_id") * 61)).drop("_base")


def timetable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide timetable payloads, one per nation: some overnight, some with gaps."""
    rows = table(spark, sf_dir, "nation")
    n = F.col("n_nationkey")

    def clock(hour, minute):
        return F.format_string("%02d:%02d", (hour % 24).cast("int"), (minute % 60).cast("int"))

    columns = {"routeId": n.cast("string")}
    for i, prefix in enumerate(("we", "sat", "sun")):
        for j, side in enumerate(("Up", "Down")):
            first, last = clock(n % 4 + 4 + i, n * 7 + j * 10), clock(n % 5 + 20 + j + i, n * 11)
            columns[f"{prefix}{side}FirstTime"] = F.when((n + i + j) % 5 != 0, first).otherwise("0")
            columns[f"{prefix}{side}LastTime"] = F.when((n + i) % 6 != 0, last)
        columns[f"{prefix}PeekAlloc"] = F.when((n + i) % 3 != 0, (n + 8).cast("string"))
        columns[f"{prefix}NPeekAlloc"] = F.when((n + i) % 4 != 0, (n + 15).cast("string"))
    for j, side in enumerate(("up", "down")):
        columns[f"{side}FirstTime"] = F.when(n % 3 != 0, clock(n % 3 + 5, n + j))
        columns[f"{side}LastTime"] = clock(n % 3 + 22, n + 5)
    columns["peekAlloc"], columns["nPeekAlloc"] = F.lit("12"), F.lit("25")
    return rows.select(*[c.alias(name) for name, c in columns.items()])
