"""Landed JSON payloads to snapshot rows."""

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions import text

# Result codes that mean success.
OK_CODES = ("0", "00", "0000")
_HEADER = "struct<resultCode: string, resultCd: string, resultMessage: string, resultMsg: string>"
_PARTS = f"msgHeader: {_HEADER}, header: {_HEADER}, msgBody: string, body: string"
# One parse reads headers and keeps bodies as text, whether or not everything sits under "response".
_ENVELOPE = f"struct<response: struct<{_PARTS}>, {_PARTS}>"


def read_envelopes(payloads: DataFrame, item_schema: str, item_key: str | None = None, column: str = "value"):
    """Flatten API envelopes: (items, rejects).

    The header and body may be named in two ways each, and the items may be a list, one bare object, or absent. Error
    codes go to ``rejects``, except code 4 with a "no result" message, which is simply empty.
    """
    parsed = payloads.withColumn("_e", F.from_json(column, _ENVELOPE))
    heads = [f"_e.{root}{head}" for root in ("response.", "") for head in ("msgHeader", "header")]
    code = F.coalesce(*[F.col(f"{h}.{c}") for h in heads for c in ("resultCode", "resultCd")])
    message = F.coalesce(*[F.col(f"{h}.{c}") for h in heads for c in ("resultMessage", "resultMsg")], F.lit("unknown error"))
    body = F.coalesce(
        *[text.present(F.col(f"_e.response.{b}")) for b in ("msgBody", "body")],
        F.get_json_object(column, "$.response"),
        *[text.present(F.col(f"_e.{b}")) for b in ("msgBody", "body")],
        F.col(column),
    )
    names = ([item_key] if item_key else []) + ["items.item", "items", "item"]
    read = parsed.select(*payloads.columns, code.alias("result_code"), message.alias("result_message"), body.alias("_body"))
    listed = F.coalesce(*[F.get_json_object("_body", f"$.{n}") for n in names], *([] if item_key else [F.col("_body")]))
    read = read.withColumn("_items", listed).drop("_body")
    ok = F.col("result_code").isNull() | F.col("result_code").isin(*OK_CODES)
    empty = (F.col("result_code") == "4") & F.col("result_message").contains("결과") & F.col("result_message").contains("존재")
    items = read.where(ok).select(
        *[c for c in payloads.columns if c != column], F.explode(F.from_json("_items", f"array<struct<{_ddl(item_schema)}>>")).alias("_item")
    )
    others = [c for c in payloads.columns if c != column]
    rejects = read.where(~ok & ~empty).drop("_items")
    return items.where("_item IS NOT NULL").select(*others, "_item.*"), rejects


def _ddl(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (field.strip().split(" ", 1) for field in schema.split(",")))


def _raw(items: DataFrame) -> Column:
    return F.to_json(F.struct(*items.columns))


def location_snapshots(items: DataFrame, collected_at: Column | None = None) -> DataFrame:
    """Position items to snapshot rows; one collection time per batch."""
    at = collected_at if collected_at is not None else F.col("collected_at")
    return items.select(
        at.cast("timestamp").alias("collected_at"),
        text.strict_int(F.col("routeId")).alias("route_id"),
        text.strict_int(F.col("vehId")).alias("veh_id"),
        text.present(F.col("plateNo")).alias("plate_no"),
        text.strict_int(F.col("stationId")).alias("station_id"),
        *[
            text.strict_int(F.col(source)).cast("int").alias(name)
            for source, name in (
                ("stationSeq", "station_seq"), ("remainSeatCnt", "remain_seat_cnt"), ("crowded", "crowded"),
                ("routeTypeCd", "route_type_cd"), ("lowPlate", "low_plate"), ("stateCd", "state_cd"), ("taglessCd", "tagless_cd"),
            )
        ],
        _raw(items).alias("raw_json"),
    )


def arrival_snapshots(items: DataFrame, collected_at: Column | None = None) -> DataFrame:
    """Arrival items to snapshot rows, two vehicle slots wide."""
    at = collected_at if collected_at is not None else F.col("collected_at")
    slots = []
    for s in (1, 2):
        for source, name in (
            ("predictTime", "predict_time"), ("predictTimeSec", "predict_time_sec"), ("remainSeatCnt", "remain_seat_cnt"), ("crowded", "crowded"),
        ):
            slots.append(text.strict_int(F.col(f"{source}{s}")).cast("int").alias(f"{name}{s}"))
        slots.append(text.present(F.col(f"plateNo{s}")).alias(f"plate_no{s}"))
        slots.append(text.strict_int(F.col(f"vehId{s}")).alias(f"veh_id{s}"))
    return items.select(
        at.cast("timestamp").alias("collected_at"),
        text.strict_int(F.col("stationId")).alias("station_id"),
        text.strict_int(F.col("routeId")).alias("route_id"),
        text.present(F.col("routeName")).alias("route_name"),
        text.strict_int(F.col("routeTypeCd")).cast("int").alias("route_type_cd"),
        text.strict_int(F.col("staOrder")).cast("int").alias("sta_order"),
        text.strict_int(F.col("turnSeq")).cast("int").alias("turn_seq"),
        text.present(F.col("flag")).alias("flag"),
        *slots,
        _raw(items).alias("raw_json"),
    )


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append, partitioned by collection day so that time filters prune folders."""
    day = F.to_date("collected_at")
    snapshots.withColumn("ingest_date", day).write.mode("append").partitionBy("ingest_date").parquet(path)


def merge_detail(found: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Search row with its detail row; a field the detail has wins."""
    extra = [c for c in detail.columns if c not in found.columns]
    joined = found.alias("_s").join(detail.alias("_d"), F.col(f"_s.{key}") == F.col(f"_d.{key}"), "left")
    merged = [
        F.coalesce(f"_d.{c}", f"_s.{c}").alias(c) if c in detail.columns and c != key else F.col(f"_s.{c}").alias(c)
        for c in found.columns
    ]
    return joined.select(*merged, *[F.col(f"_d.{c}").alias(c) for c in extra])


def route_audit(locations: DataFrame, stations: DataFrame, routes: DataFrame) -> DataFrame:
    """Per route: stop and position counts, which fields are ever filled, one sample position."""
    def filled(name):
        return F.coalesce(F.bool_or(F.col(name).isNotNull()), F.lit(False))

    positions = locations.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("location_count"),
        filled("remain_seat_cnt").alias("has_remain_seat_cnt"),
        filled("crowded").alias("has_crowded"),
        filled("station_seq").alias("has_station_seq"),
        F.min_by("raw_json", F.struct("collected_at", "station_seq", "veh_id")).alias("sample_location"),
    )
    stops = stations.groupBy("route_id").agg(F.count(F.lit(1)).alias("station_count"))
    joined = routes.join(stops, "route_id", "left").join(positions, "route_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("station_count", "location_count")}
    no = {c: F.coalesce(c, F.lit(False)) for c in ("has_remain_seat_cnt", "has_crowded", "has_station_seq")}
    return joined.withColumns({**zero, **no})
