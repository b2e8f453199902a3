"""Rows to score for arrivals of a poll: live vehicles where seen, else timetable-and-history proxies."""

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions import seats, text, times
from kerbline.operators import proxy
from kerbline.operators.features import observed_capacity, route_capacity
from kerbline.operators.schedule import request_direction, schedule_context

SLOT_FIELDS = ("predict_time", "predict_time_sec", "remain_seat_cnt", "crowded", "plate_no", "veh_id")


def for_route(arrivals: DataFrame, route_id: int | None = None, route_name: str | None = None) -> DataFrame:
    if route_id is not None:
        arrivals = arrivals.where(F.col("route_id") == route_id)
    if route_name:
        arrivals = arrivals.where(text.canonical_route(F.col("route_name")) == text.canonical_route(F.lit(route_name)))
    return arrivals


def arrival_slots(arrivals: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Two vehicle slots per arrival to rows; a slot without plate and estimate is empty and dropped."""
    shared = [c for c in arrivals.columns if c not in {f"{f}{s}" for f in SLOT_FIELDS for s in (1, 2)}]
    slots = F.array(
        *[F.struct(F.lit(s).alias("arrival_slot"), *[F.col(f"{f}{s}").alias(f) for f in SLOT_FIELDS]) for s in (1, 2)]
    )
    rows = arrivals.select(*shared, F.inline(slots))
    filled = F.coalesce(text.present(F.col("plate_no")), F.col("predict_time").cast("string"), F.col("predict_time_sec").cast("string"))
    rows = rows.withColumn("has_candidate", filled.isNotNull().cast("int"))
    return rows if keep_empty else rows.where("has_candidate = 1").drop("has_candidate")


def arrival_diagnostics(arrivals: DataFrame) -> DataFrame:
    """Arrivals, usable slots, and why nothing can be scored."""
    slots = arrival_slots(arrivals, keep_empty=True)
    counted = slots.agg(F.count_if(F.col("arrival_slot") == 1).alias("arrivals"), F.coalesce(F.sum("has_candidate"), F.lit(0)).alias("arrival_candidate_slots"))
    reason = (
        F.when(F.col("arrivals") == 0, "no_arrival_after_filter")
        .when(F.col("arrival_candidate_slots") == 0, "arrival_exists_but_no_vehicle_fields")
        .otherwise("arrival_vehicle_fields_present")
    )
    return counted.withColumn("empty_reason", reason)


def with_position(slots: DataFrame, positions: DataFrame) -> DataFrame:
    """Attach the vehicle's live position: by vehicle id, else by plate; the last duplicate wins."""
    state = F.struct("station_seq", "station_id", "remain_seat_cnt", "crowded", "veh_id", "plate_no")
    by_vehicle = positions.where("veh_id IS NOT NULL").groupBy("route_id", "veh_id").agg(
        F.max_by(state, F.struct("collected_at", "snapshot_id")).alias("_by_vehicle")
    )
    by_plate = positions.where("plate_no IS NOT NULL").groupBy("route_id", "plate_no").agg(
        F.max_by(state, F.struct("collected_at", "snapshot_id")).alias("_by_plate")
    )
    joined = slots.join(by_vehicle, ["route_id", "veh_id"], "left").join(by_plate, ["route_id", "plate_no"], "left")
    return joined.withColumn("_seen", F.coalesce("_by_vehicle", "_by_plate")).drop("_by_vehicle", "_by_plate")


def _first_stop(stops: DataFrame) -> DataFrame:
    """Per (route, stop id) the stop with the smallest sequence."""
    fields = F.struct("station_seq", "station_name", "mobile_no", "x", "y", "raw_json")
    known = stops.where("station_id IS NOT NULL")
    return known.groupBy("route_id", "station_id").agg(F.min_by(fields, "station_seq").alias("_by_id"))


def with_stop(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Stop data by (route, sequence), else by (route, stop id); also the stop's direction."""
    fields = F.struct("station_seq", "station_name", "mobile_no", "x", "y", "raw_json")
    by_seq = stops.select("route_id", "station_seq", fields.alias("_by_seq"))
    joined = rows.join(by_seq, ["route_id", "station_seq"], "left").join(_first_stop(stops), ["route_id", "station_id"], "left")
    stop = F.coalesce("_by_seq", "_by_id")
    return joined.withColumns(
        {
            "station_name": F.coalesce(text.present(stop["station_name"]), F.lit("unknown")),
            "mobile_no": F.coalesce(text.present(stop["mobile_no"]), F.lit("unknown")),
            "x": F.coalesce(stop["x"], F.lit(0.0)),
            "y": F.coalesce(stop["y"], F.lit(0.0)),
            "station_direction": text.direction(F.get_json_object(stop["raw_json"], "$.direction")),
        }
    ).drop("_by_seq", "_by_id")


def with_route(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Route data, else what the arrival itself says."""
    known = routes.select(
        "route_id", F.struct("route_name", "canonical_route_name", "route_type_cd", "route_type_name").alias("_route")
    )
    joined = rows.join(known, "route_id", "left")
    own_name = F.coalesce(text.present(F.col("route_name")), F.lit("unknown"))
    found = F.col("_route").isNotNull()

    def of(field, own):
        return F.when(found, F.col(f"_route.{field}")).otherwise(own)

    return joined.withColumns(
        {
            "canonical_route_name": of("canonical_route_name", text.canonical_route(own_name)),
            "route_name": of("route_name", own_name),
            "route_type_cd": of("route_type_cd", F.coalesce("route_type_cd", F.lit(0))),
            "route_type_name": of("route_type_name", F.lit("unknown")),
        }
    ).drop("_route")


def with_requested_name(rows: DataFrame, stops: DataFrame) -> DataFrame:
    names = _first_stop(stops).select(
        "route_id", F.col("station_id").alias("requested_station_id"), F.col("_by_id.station_name").alias("requested_station_name")
    )
    joined = rows.join(names, ["route_id", "requested_station_id"], "left")
    return joined.withColumn("requested_station_name", F.coalesce(text.present(F.col("requested_station_name")), F.lit("unknown")))


def live_rows(arrivals: DataFrame, positions: DataFrame, history: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Base feature rows of vehicles the arrivals announce, for all requests of a poll at once.

    ``arrivals`` carries ``request_id``, ``requested_station_id`` and ``collected_at``; ``history`` gives capacities.
    """
    return rows_of_slots(with_position(arrival_slots(arrivals.where("route_id IS NOT NULL")), positions), history, routes, stops)


def rows_of_slots(slots: DataFrame, history: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Base feature rows of arrival slots that carry their vehicle's position as ``_seen``, null if there is none."""
    seen = F.col("_seen")
    rows = slots.withColumns(
        {
            "station_seq": F.coalesce(seen["station_seq"], "sta_order", F.lit(0)).cast("int"),
            "station_id": F.coalesce(seen["station_id"], "station_id", "requested_station_id", F.lit(0)),
            "remain_seat_cnt": F.coalesce("remain_seat_cnt", seen["remain_seat_cnt"], F.lit(-1)),
            "crowded": F.coalesce("crowded", seen["crowded"], F.lit(0)),
            "_plate": F.col("plate_no"),
            "veh_id": F.coalesce(F.when(F.col("veh_id") != 0, F.col("veh_id")), seen["veh_id"], F.lit(0)),
            "plate_no": F.coalesce("plate_no", seen["plate_no"], F.lit("unknown")),
            "matched_location": seen.isNotNull().cast("int"),
            "feature_source": F.when(seen.isNotNull(), "position_match").otherwise("arrival_only"),
        }
    ).drop("_seen")
    rows = with_stop(with_route(rows, routes), stops)
    by_plate = observed_capacity(history).withColumnRenamed("plate_no", "_plate")
    rows = rows.join(by_plate, ["route_id", "_plate"], "left").join(route_capacity(history), "route_id", "left")
    observed = F.when(F.col("_plate").isNotNull(), F.col("observed_capacity")).otherwise(F.col("route_capacity"))
    rows = rows.withColumn("_capacity", seats.estimate_capacity(F.col("route_type_cd"), observed))
    remain = F.col("remain_seat_cnt")
    rows = rows.withColumns(
        {
            "snapshot_id": (-F.col("arrival_slot")).cast("bigint"),
            "crowded_label": F.coalesce(seats.crowded_label(F.col("crowded")), F.lit("unknown")),
            "estimated_capacity": F.coalesce("_capacity", F.lit(45)),
            "seat_scarcity_score": F.when(remain >= 0, seats.scarcity(remain, F.col("_capacity"))).otherwise(0),
            **seats.seat_flags(remain),
            "prediction_mode": F.lit("live_vehicle"),
        }
    )
    rows = rows.drop("_capacity", "_plate", "observed_capacity", "route_capacity", "station_direction", "raw_json", "flag", "sta_order", "turn_seq")
    rows = rows.withColumns(times.kst_parts(F.col("collected_at")))
    return with_requested_name(rows, stops)


def schedule_requests(arrivals: DataFrame, stops: DataFrame) -> DataFrame:
    """One schedule request per arrival: stop sequence and direction resolved."""
    first = _first_stop(stops).select("route_id", "station_id", F.col("_by_id.station_seq").alias("_stop_seq"))
    rows = arrivals.withColumn("station_id", F.coalesce("station_id", "requested_station_id")).join(first, ["route_id", "station_id"], "left")
    rows = rows.withColumn("station_seq", F.coalesce("sta_order", "_stop_seq")).drop("_stop_seq")
    rows = with_stop(rows, stops)
    own = F.col("direction") if "direction" in arrivals.columns else F.lit(None).cast("string")
    return rows.withColumn(
        "schedule_direction", request_direction(F.col("station_direction"), own, F.col("sta_order"), F.col("turn_seq"))
    )


def route_requests(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Arrival-shaped rows for requests without arrivals: by route id, else every route of the asked name."""
    by_id = requests.where("asked_route_id IS NOT NULL").withColumn("route_id", F.col("asked_route_id"))
    named = requests.where("asked_route_id IS NULL AND asked_route_name IS NOT NULL").withColumn(
        "_name", text.canonical_route(F.col("asked_route_name"))
    )
    by_name = named.join(routes.select("route_id", F.col("canonical_route_name").alias("_name")), "_name").drop("_name")
    rows = by_id.unionByName(by_name)
    return rows.withColumns(
        {
            "route_name": F.coalesce("asked_route_name", F.col("route_id").cast("string")),
            "station_id": F.col("requested_station_id"),
            "route_type_cd": F.lit(None).cast("int"),
            "sta_order": F.lit(None).cast("int"),
            "turn_seq": F.lit(None).cast("int"),
        }
    ).drop("asked_route_id", "asked_route_name")


def scheduled_rows(
    requests: DataFrame,
    timetables: DataFrame,
    holidays: DataFrame,
    routes: DataFrame,
    stops: DataFrame,
    statistics: DataFrame,
    history: DataFrame,
) -> DataFrame:
    """Base feature rows at the proxy time, with the bus state taken from history."""
    requests = requests.where("route_id IS NOT NULL")
    rows = schedule_context(schedule_requests(requests, stops), timetables, holidays)
    rows = with_route(rows, routes)
    rows = rows.withColumns({"input_at_kst": times.iso_kst(F.col("at")), "collected_at": F.coalesce("schedule_proxy_at", "at")})
    rows = rows.withColumns(times.kst_parts(F.col("collected_at")))
    closed = holidays.groupBy("service_date").agg(F.max("is_holiday").alias("is_holiday"))
    rows = rows.join(closed, "service_date", "left").withColumn("is_holiday", (F.coalesce("is_holiday", F.lit(0)) == 1).cast("int"))
    rows = proxy.with_proxy(rows, statistics).join(route_capacity(history), "route_id", "left")
    capacity: Column = seats.estimate_capacity(F.col("route_type_cd"), F.col("route_capacity"))
    rows = proxy.hide_bus_state(rows, capacity, "scheduled_proxy")
    rows = rows.withColumns(
        {
            "veh_id": F.lit(0).cast("bigint"),
            "station_id": F.coalesce("station_id", F.lit(0)),
            "station_seq": F.coalesce("station_seq", F.lit(0)),
            "prediction_mode": F.lit("schedule_prior"),
            "feature_source": F.lit("schedule_historical_proxy"),
        }
    )
    rows = rows.drop("is_holiday", "route_capacity", "station_direction", "flag", "sta_order", "turn_seq", "at")
    return with_requested_name(rows, stops)


def without_live(arrivals: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """Arrivals of requests that announce no usable vehicle; decided on the arrivals (or their usable slots) alone, before any join."""
    usable = arrival_slots(arrivals) if slots is None else slots
    seen = usable.where("route_id IS NOT NULL").select("request_id").distinct()
    return arrivals.join(seen, "request_id", "left_anti")


def choose_rows(arrivals: DataFrame, live: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Live rows where a request has any, else its scheduled rows, else one ``none`` row.

    ``scheduled`` holds the rows of ``without_live`` arrivals, one per arrival with a route.
    """
    routed = arrivals.where("route_id IS NOT NULL").select("request_id").distinct()
    empty = arrivals.select("request_id").distinct().join(routed, "request_id", "left_anti")
    rows = live.unionByName(scheduled, allowMissingColumns=True)
    return rows.unionByName(empty.withColumn("prediction_mode", F.lit("none")), allowMissingColumns=True)
