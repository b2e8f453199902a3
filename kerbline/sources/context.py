"""External context (weather, air, traffic, holidays, events) and daily stop demand from CSV or landed rows."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbline.functions import seats, text, times
from kerbline.sources.upsert import latest_per_key


def pick(rows: DataFrame, *names: str) -> Column:
    """First filled of the alias columns that are there; null when none is."""
    have = [text.present(F.col(f"`{n}`")) for n in names if n in rows.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def _kept(rows: DataFrame, source: Column) -> list[Column]:
    """Source tag, the payload as JSON, and the file-order columns of a reader (named with ``_``) when there are any."""
    own = [f"`{c}`" for c in rows.columns if not c.startswith("_")]
    order = [F.col(c) for c in rows.columns if c.startswith("_")]
    return [source.alias("source"), F.to_json(F.struct(*own)).alias("raw_json"), *order]


def _number(rows, *names):
    return text.number_or(pick(rows, *names), 0.0)


def _calendar(at: Column) -> list[Column]:
    wall = times.kst_wall(at)
    return [at.alias("observed_at"), times.iso_kst(at).alias("observed_at_kst"), F.to_date(wall).alias("service_date"), F.hour(wall).alias("hour")]


def weather(rows: DataFrame, source: Column) -> DataFrame:
    at = times.parse_kst(pick(rows, "tm"))
    rain, cloud = _number(rows, "rn"), _number(rows, "dc10Tca")
    return rows.select(
        F.coalesce(pick(rows, "stnId"), F.lit("unknown")).alias("weather_station_id"),
        F.coalesce(pick(rows, "stnNm"), F.lit("unknown")).alias("weather_station_name"),
        *_calendar(at),
        _number(rows, "ta").alias("temperature"),
        rain.alias("precipitation"),
        _number(rows, "hm").alias("humidity"),
        _number(rows, "ws").alias("wind_speed"),
        cloud.alias("cloud_amount"),
        seats.weather_text(rain, cloud).alias("weather_text"),
        *_kept(rows, source),
    ).where("observed_at IS NOT NULL")


def air(rows: DataFrame, source: Column) -> DataFrame:
    at = times.parse_kst(pick(rows, "observed_at_kst", "dataTime", "tm"))
    return rows.select(
        F.coalesce(pick(rows, "air_station_name", "stationName"), F.lit("unknown")).alias("air_station_name"),
        *_calendar(at),
        *[_number(rows, name, f"{name}Value").alias(name) for name in ("pm10", "pm25", "o3", "khai")],
        F.coalesce(pick(rows, "air_quality_grade", "khaiGrade"), F.lit("unknown")).alias("air_quality_grade"),
        *_kept(rows, source),
    ).where("observed_at IS NOT NULL")


def traffic(rows: DataFrame, source: Column) -> DataFrame:
    at = times.parse_kst(pick(rows, "observed_at_kst", "tm"))
    return rows.select(
        F.coalesce(pick(rows, "traffic_context_key", "roadSectionId"), F.lit("global")).alias("traffic_context_key"),
        *_calendar(at),
        _number(rows, "avg_speed", "speed").alias("avg_speed"),
        _number(rows, "traffic_volume", "volume").alias("traffic_volume"),
        _number(rows, "delay_time", "delayTime").alias("delay_time"),
        text.int_or(pick(rows, "congestion_level", "congestionLevel"), 0).cast("int").alias("congestion_level"),
        *_kept(rows, source),
    ).where("observed_at IS NOT NULL")


def holidays(rows: DataFrame, source: Column) -> DataFrame:
    """A listed day counts as a holiday unless its mark says 0 or N."""
    return rows.select(
        times.kst_date(pick(rows, "service_date", "locdate")).alias("service_date"),
        text.flag_or(pick(rows, "is_holiday", "isHoliday"), 1).alias("is_holiday"),
        F.coalesce(pick(rows, "holiday_name", "dateName"), F.lit("")).alias("holiday_name"),
        *_kept(rows, source),
    ).where("service_date IS NOT NULL")


def events(rows: DataFrame, source: Column) -> DataFrame:
    """A listed event counts once unless a count is given; a given 0 stays 0."""
    return rows.select(
        F.coalesce(pick(rows, "area_key", "regionName"), F.lit("global")).alias("area_key"),
        times.kst_date(pick(rows, "service_date", "event_date", "beginDate")).alias("service_date"),
        text.int_or(pick(rows, "event_count", "eventCount"), 1).cast("int").alias("event_count"),
        text.int_or(pick(rows, "event_nearby_count", "eventNearbyCount"), 1).cast("int").alias("event_nearby_count"),
        *_kept(rows, source),
    ).where("service_date IS NOT NULL")


KINDS = {
    "weather": (weather, ("weather_station_id", "observed_at_kst")),
    "air": (air, ("air_station_name", "observed_at_kst")),
    "traffic": (traffic, ("traffic_context_key", "observed_at_kst")),
    "holiday": (holidays, ("service_date",)),
    "event": (events, ("area_key", "service_date")),
}


def _read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Header-named CSV as text, with ``_line``: place in the input, so that the last line of a key can win."""
    raw = spark.read.option("header", True).csv(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    return raw.withColumn("_line", place)


def read_context_csv(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Rows of one kind from header-named CSV files, tagged with their file; the last line of a key wins."""
    if kind not in KINDS:
        raise ValueError(f"unknown context kind {kind}; one of {', '.join(KINDS)}")
    normalise, key = KINDS[kind]
    rows = normalise(_read_lines(spark, path), F.concat(F.lit("csv:"), F.col("_line.file_path")))
    return latest_per_key(rows, key, ["_line"]).drop("_line")


def station_demand(rows: DataFrame) -> DataFrame:
    """Daily boardings per stop; English, camel-case and Korean column names."""
    def total(*names):
        return F.coalesce(text.comma_int(pick(rows, *names)), F.lit(0)).cast("int")

    return rows.select(
        times.service_day(pick(rows, "service_date", "일자", "use_date")).alias("service_date"),
        text.comma_int(pick(rows, "station_id", "정류소아이디", "stationId")).alias("station_id"),
        pick(rows, "mobile_no", "정류소ARS", "mobileNo").alias("mobile_no"),
        pick(rows, "station_name", "정류소명", "stationName").alias("station_name"),
        pick(rows, "city_name", "시군명", "cityName").alias("city_name"),
        total("boarding_total", "승차인원합계", "boardingTotal").alias("boarding_total"),
        total("first_boarding_total", "최초승차인원수", "firstBoardingTotal").alias("first_boarding_total"),
        total("transfer_total", "환승인원수", "transferTotal").alias("transfer_total"),
        total("alighting_total", "하차인원합계", "alightingTotal").alias("alighting_total"),
        *[F.col(c) for c in rows.columns if c.startswith("_")],
    ).where("service_date IS NOT NULL AND station_id IS NOT NULL")


def read_station_demand_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = station_demand(_read_lines(spark, path))
    return latest_per_key(rows, ["service_date", "station_id"], ["_line"]).drop("_line")


def event_days(spans: DataFrame, start: Column, end: Column, first: str, last: str, area_key: str = "global") -> DataFrame:
    """Events per day from date spans clipped to [first, last]; a missing end is the start day."""
    low = F.greatest(start, F.lit(first).cast("date"))
    high = F.least(F.coalesce(end, start), F.lit(last).cast("date"))
    days = spans.select(low.alias("_low"), high.alias("_high")).where("_low <= _high")
    days = days.groupBy("_low", "_high").agg(F.count(F.lit(1)).alias("_n"))
    per_day = days.select("_n", F.explode(F.sequence("_low", "_high")).alias("service_date"))
    counted = per_day.groupBy("service_date").agg(F.sum("_n").cast("bigint").alias("event_count"))
    return counted.select(F.lit(area_key).alias("area_key"), "service_date", "event_count", F.col("event_count").alias("event_nearby_count"))


def date_range(spark: SparkSession, first: str, last: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("service_date"))
    return days
