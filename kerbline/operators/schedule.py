"""Timetable context: which service day, window and headway apply to a request."""

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions import text, times
from kerbline.operators.nearest import day_type

# Field prefixes of the day types.
DAY_PREFIXES = {"weekday": "we", "saturday": "sat", "sunday_holiday": "sun"}


def timetable(route_info: DataFrame) -> DataFrame:
    """Wide route payload to one row per (route, direction) with a struct per day type.

    A day type's own field wins, else the undated field of the direction.
    """
    directions = []
    for name in ("up", "down"):
        side = name.capitalize()
        days = []
        for day, prefix in DAY_PREFIXES.items():
            days.append(
                F.struct(
                    text.first_nonzero_text(F.col(f"{prefix}{side}FirstTime"), F.col(f"{name}FirstTime")).alias("first"),
                    text.first_nonzero_text(F.col(f"{prefix}{side}LastTime"), F.col(f"{name}LastTime")).alias("last"),
                    text.first_int(F.col(f"{prefix}PeekAlloc"), F.col("peekAlloc")).alias("peak"),
                    text.first_int(F.col(f"{prefix}NPeekAlloc"), F.col("nPeekAlloc")).alias("off_peak"),
                ).alias(day)
            )
        directions.append(F.struct(F.lit(name).alias("direction"), *days))
    return route_info.select(text.strict_int(F.col("routeId")).alias("route_id"), F.inline(F.array(*directions)))


def request_direction(station_direction: Column, own_direction: Column, sta_order: Column, turn_seq: Column) -> Column:
    """The stop's direction, else the request's own, else down past the turning stop."""
    named = text.direction(F.coalesce(text.present(station_direction), text.present(own_direction)))
    return F.coalesce(named, F.when(sta_order > turn_seq, "down").otherwise("up"))


def _by_day(day: Column) -> Column:
    return F.when(day == "weekday", F.col("weekday")).when(day == "saturday", F.col("saturday")).otherwise(F.col("sunday_holiday"))


def schedule_context(requests: DataFrame, timetables: DataFrame, holidays: DataFrame) -> DataFrame:
    """Adds the timetable columns to requests with ``route_id``, ``at`` (instant) and ``schedule_direction``.

    After midnight a request belongs to yesterday while yesterday's window is still open.
    """
    wall = times.kst_wall(F.col("at"))
    closed = holidays.groupBy("service_date").agg(F.max("is_holiday").alias("_holiday"))
    rows = requests.withColumns({"_wall": wall, "_today": F.to_date(wall), "_yesterday": F.date_sub(F.to_date(wall), 1)})
    for name in ("_today", "_yesterday"):
        rows = rows.join(closed.select(F.col("service_date").alias(name), F.col("_holiday").alias(f"{name}_off")), name, "left")
    minute = times.minute_of_day(F.col("_wall"))
    known = timetables.withColumnRenamed("direction", "schedule_direction")
    rows = rows.join(known, ["route_id", "schedule_direction"], "left")
    today = day_type(F.col("_wall"), F.coalesce("_today_off", F.lit(0)))
    before = day_type(F.col("_yesterday").cast("timestamp"), F.coalesce("_yesterday_off", F.lit(0)))
    rows = rows.withColumns({"_day": today, "_before": before})
    rows = rows.withColumns({"_now": _by_day(F.col("_day")), "_prev": _by_day(F.col("_before"))})
    first, last = times.clock_minutes(F.col("_prev.first")), times.clock_minutes(F.col("_prev.last"))
    overnight = F.coalesce((first > last) & (minute <= last), F.lit(False))
    rows = rows.withColumns(
        {
            "schedule_service_date": F.when(overnight, F.col("_yesterday")).otherwise(F.col("_today")),
            "schedule_day_type": F.when(overnight, F.col("_before")).otherwise(F.col("_day")),
            "_fields": F.when(overnight, F.col("_prev")).otherwise(F.col("_now")),
        }
    )
    first, last = times.clock_minutes(F.col("_fields.first")), times.clock_minutes(F.col("_fields.last"))
    operating = times.in_service(minute, first, last)
    rows = rows.withColumns({"_open": operating, "_next": times.next_departure(F.col("_wall"), first)})
    proxy_wall = F.when(F.col("_open"), F.col("_wall")).otherwise(F.col("_next"))
    rows = rows.withColumn("_proxy_wall", proxy_wall)
    hour = F.hour(F.coalesce("_proxy_wall", "_wall"))
    peak, off_peak = F.col("_fields.peak"), F.col("_fields.off_peak")
    nonzero_off = F.when(off_peak != 0, off_peak)
    headway = F.when(times.is_headway_peak(hour) & (F.coalesce(peak, F.lit(0)) != 0), peak).otherwise(F.coalesce(nonzero_off, peak))
    rows = rows.withColumns(
        {
            "schedule_source": F.lit("route_timetable"),
            "schedule_first_time": F.col("_fields.first"),
            "schedule_last_time": F.col("_fields.last"),
            "schedule_allocation_minutes": headway,
            "scheduled_operating": F.col("_open").cast("int"),
            "schedule_proxy_at": F.to_utc_timestamp("_proxy_wall", times.KST),
            "schedule_proxy_time_basis": F.when(F.col("_open"), "requested_time").otherwise("next_first_time"),
        }
    )
    rows = rows.withColumn("schedule_proxy_at_kst", times.iso_kst(F.col("schedule_proxy_at")))
    return rows.drop(
        "_wall", "_today", "_yesterday", "_today_off", "_yesterday_off", "_day", "_before", "_now", "_prev", "_fields", "_open",
        "_next", "_proxy_wall", "weekday", "saturday", "sunday_holiday",
    )
