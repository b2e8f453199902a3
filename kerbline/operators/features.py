"""Base and model feature tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.functions import seats, text, times
from kerbline.operators.nearest import with_event, with_holiday, with_nearest

WEATHER_DEFAULTS = {
    "temperature": 0.0, "precipitation": 0.0, "humidity": 0.0, "wind_speed": 0.0, "cloud_amount": 0.0, "weather_text": "unknown",
}
AIR_DEFAULTS = {"pm10": 0.0, "pm25": 0.0, "o3": 0.0, "khai": 0.0, "air_quality_grade": "unknown"}
TRAFFIC_DEFAULTS = {"avg_speed": 0.0, "traffic_volume": 0.0, "delay_time": 0.0, "congestion_level": 0}
ROW_DEFAULTS = {
    "route_id": 0, "route_name": "unknown", "canonical_route_name": "unknown", "route_type_cd": 0, "route_type_name": "unknown",
    "veh_id": 0, "plate_no": "unknown", "station_id": 0, "station_seq": 0, "station_name": "unknown", "mobile_no": "unknown",
    "x": 0.0, "y": 0.0, "remain_seat_cnt": -1, "crowded": 0, "crowded_label": "unknown", "estimated_capacity": 45,
    "seat_scarcity_score": 0, "is_no_seat": 0, "is_low_seat_2": 0, "is_low_seat_5": 0, "time_period": "unknown", "day_name_ko": "",
}


def observed_capacity(snapshots: DataFrame) -> DataFrame:
    """Most free seats ever seen per (route, plate)."""
    seen = snapshots.where("remain_seat_cnt >= 0 AND plate_no IS NOT NULL")
    return seen.groupBy("route_id", "plate_no").agg(F.max("remain_seat_cnt").alias("observed_capacity"))


def route_capacity(snapshots: DataFrame) -> DataFrame:
    """Most free seats ever seen per route, over all plates."""
    seen = snapshots.where("remain_seat_cnt >= 0")
    return seen.groupBy("route_id").agg(F.max("remain_seat_cnt").alias("route_capacity"))


def capacity_so_far(snapshots: DataFrame) -> DataFrame:
    """Snapshots plus ``observed_capacity`` seen up to each one, so that no later row leaks into a feature.

    A plate may hold very many rows: days are combined first, and only one day of a plate is ever walked in order.
    """
    plate, seats_seen = ["route_id", "plate_no"], F.when(F.col("remain_seat_cnt") >= 0, F.col("remain_seat_cnt"))
    rows = snapshots.withColumn("_day", F.to_date("collected_at"))
    days = rows.groupBy(*plate, "_day").agg(F.max(seats_seen).alias("_most"))
    earlier = Window.partitionBy(*plate).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(*plate, "_day", F.max("_most").over(earlier).alias("_before")).where("plate_no IS NOT NULL")
    today = Window.partitionBy(*plate, "_day").orderBy("collected_at", "snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_today", F.max(seats_seen).over(today)).join(before, [*plate, "_day"], "left")
    known = F.when(F.col("plate_no").isNotNull(), F.greatest("_before", "_today"))
    return rows.withColumn("observed_capacity", known).drop("_day", "_before", "_today")


def location_features(
    snapshots: DataFrame, routes: DataFrame, stops: DataFrame, capacity: DataFrame | None = None, *, as_of: bool = False
) -> DataFrame:
    """Snapshots of known routes with stop data, calendar parts, capacity, scarcity and seat flags.

    The dimension sides carry no broadcast hint: Spark broadcasts them while they are below its size threshold and
    falls back to a (skew-aware) shuffle join beyond it. ``capacity`` may come from a longer log than ``snapshots``.
    Capacity looks at all times by default; with ``as_of`` only at the rows up to each snapshot.
    """
    route = routes.select(
        "route_id",
        F.coalesce("route_name", "canonical_route_name").alias("route_name"),
        "canonical_route_name",
        F.col("route_type_cd").alias("_route_type"),
        "route_type_name",
    )
    stop = stops.select("route_id", "station_seq", "station_name", "mobile_no", "x", "y")
    if as_of:
        rows = capacity_so_far(snapshots)
    else:
        rows = snapshots.join(observed_capacity(snapshots) if capacity is None else capacity, ["route_id", "plate_no"], "left")
    joined = rows.join(route, "route_id").join(stop, ["route_id", "station_seq"], "left")
    joined = joined.withColumn("route_type_cd", F.coalesce("route_type_cd", "_route_type"))
    joined = joined.withColumn("estimated_capacity", seats.batch_capacity(F.col("route_type_cd"), F.col("observed_capacity")))
    remain = F.col("remain_seat_cnt")
    return joined.select(
        "snapshot_id",
        "collected_at",
        *[c.alias(n) for n, c in times.kst_parts(F.col("collected_at")).items()],
        "route_id", "route_name", "canonical_route_name", "route_type_cd", "route_type_name",
        "veh_id", "plate_no", "station_id", "station_seq", "station_name", "mobile_no", "x", "y",
        "remain_seat_cnt", "crowded",
        seats.crowded_label(F.col("crowded")).alias("crowded_label"),
        "state_cd", "low_plate", "tagless_cd",
        "estimated_capacity",
        F.when(remain >= 0, seats.scarcity(remain, F.col("estimated_capacity"))).alias("seat_scarcity_score"),
        *[c.alias(n) for n, c in seats.seat_flags(remain).items()],
        F.coalesce("raw_json", F.lit("{}")).alias("raw_json"),
    )


def live_calendar(rows: DataFrame) -> DataFrame:
    """Fill absent calendar columns of live rows from ``collected_at``; columns already there are kept."""
    parts = times.kst_parts(F.col("collected_at"))
    have = set(rows.columns)
    filled = {n: (F.coalesce(F.col(n), c) if n in have else c) for n, c in parts.items()}
    if "snapshot_id" not in have:
        filled["snapshot_id"] = F.lit(0).cast("bigint")
    return rows.withColumns(filled)


def kst_hour(instant: Column) -> Column:
    """Start of the snapshot's Korean hour, as an instant (+09:00 is a whole number of hours)."""
    return F.date_trunc("hour", instant)


def model_features(
    base: DataFrame,
    weather: DataFrame,
    air: DataFrame,
    traffic: DataFrame,
    holidays: DataFrame,
    events: DataFrame,
    *,
    by: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Base rows with context attached and every feature filled, so that none is null; ``keep`` passes columns on."""
    rows = base.withColumn("hour_at", kst_hour(F.col("collected_at")))
    rows = with_nearest(rows, weather, WEATHER_DEFAULTS, "weather_imputed", key="weather_station_id", by=by)
    rows = with_nearest(rows, air, AIR_DEFAULTS, "air_quality_imputed", key="air_station_name", by=by)
    rows = with_nearest(rows, traffic, TRAFFIC_DEFAULTS, "traffic_imputed", key="traffic_context_key", by=by)
    rows = with_event(with_holiday(rows, holidays), events)
    filled = {
        name: text.text_or(F.col(name), value) if isinstance(value, str) else F.coalesce(name, F.lit(value))
        for name, value in ROW_DEFAULTS.items()
    }
    rows = rows.withColumns({**filled, "observed_hour_kst": times.iso_kst(F.col("hour_at"))})
    return rows.select(
        "snapshot_id", "collected_at", "collected_at_kst", "observed_hour_kst", "service_date", "day_of_week", "day_name_ko",
        "is_weekend", "is_holiday", "holiday_name", "hour", "time_bucket_10m", "time_period",
        "route_id", "route_name", "canonical_route_name", "route_type_cd", "route_type_name", "veh_id", "plate_no",
        "station_id", "station_seq", "station_name", "mobile_no", "x", "y", "remain_seat_cnt", "crowded", "crowded_label",
        "estimated_capacity", "seat_scarcity_score", "is_no_seat", "is_low_seat_2", "is_low_seat_5",
        *WEATHER_DEFAULTS, "weather_imputed", *AIR_DEFAULTS, "air_quality_imputed",
        *TRAFFIC_DEFAULTS, "traffic_imputed", "event_count", "event_nearby_count", "event_imputed", *keep,
    )


def feature_summary(features: DataFrame) -> DataFrame:
    """Counters of a feature build."""
    flags = ("weather_imputed", "air_quality_imputed", "traffic_imputed", "event_imputed")
    return features.agg(
        F.count(F.lit(1)).alias("processed"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in flags]
    )


def date_range(features: DataFrame) -> DataFrame:
    return features.agg(F.min("service_date").alias("start_date"), F.max("service_date").alias("end_date"))
