"""Route and stop dimensions."""

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.constants import TARGET_ROUTE_NAMES
from kerbline.functions import text
from kerbline.sources.snapshots import merge_detail
from kerbline.sources.upsert import latest_per_key, missing_names


def target_routes(items: DataFrame) -> DataFrame:
    """Route items to the route dimension; rows without a numeric id are dropped."""
    return items.select(
        text.strict_int(F.col("routeId")).alias("route_id"),
        text.canonical_route(F.col("routeName")).alias("canonical_route_name"),
        F.col("routeName").alias("route_name"),
        text.strict_int(F.col("routeTypeCd")).cast("int").alias("route_type_cd"),
        F.col("routeTypeName").alias("route_type_name"),
        F.col("regionName").alias("region_name"),
        F.col("startStationName").alias("start_station_name"),
        F.col("endStationName").alias("end_station_name"),
        F.to_json(F.struct(*items.columns)).alias("raw_json"),
    ).where("route_id IS NOT NULL")


def route_stations(items: DataFrame, route_id: Column, canonical_name: Column) -> DataFrame:
    """Stop items to the stop dimension; the sequence falls back to the arrival order, rows without one are dropped."""
    return items.select(
        route_id.cast("bigint").alias("route_id"),
        text.strict_int(text.first_nonzero_text(F.col("stationSeq"), F.col("staOrder"))).cast("int").alias("station_seq"),
        text.strict_int(F.col("stationId")).alias("station_id"),
        canonical_name.alias("canonical_route_name"),
        F.col("stationName").alias("station_name"),
        F.col("mobileNo").alias("mobile_no"),
        F.trim("x").try_cast("double").alias("x"),
        F.trim("y").try_cast("double").alias("y"),
        F.col("regionName").alias("region_name"),
        F.col("centerYn").alias("center_yn"),
        F.col("turnYn").alias("turn_yn"),
        F.to_json(F.struct(*items.columns)).alias("raw_json"),
    ).where("station_seq IS NOT NULL")


def landed_target_routes(found: DataFrame, detail: DataFrame, keyword: str | None = None) -> dict[str, DataFrame]:
    """Search and detail landings to the route dimension and the expected names nobody found.

    ``found`` carries ``landed_at``; the latest landing of a route wins.
    """
    region = [F.coalesce(F.col(c), F.lit("")) for c in ("regionName", "districtCd", "startStationName", "endStationName", "adminName")]
    wanted = found.where(text.is_target_route(F.col("routeName"), region, keyword))
    wanted = wanted.where(text.strict_int(F.col("routeId")).isNotNull())
    newest = latest_per_key(wanted, ["routeId"], ["landed_at"]).drop("landed_at")
    routes = target_routes(merge_detail(newest, latest_per_key(detail, ["routeId"], ["landed_at"]).drop("landed_at"), "routeId"))
    spark = found.sparkSession
    expected = spark.createDataFrame([(n,) for n in TARGET_ROUTE_NAMES], "canonical_route_name STRING")
    return {"routes": routes, "missing": missing_names(expected, routes, "canonical_route_name")}


def route_ids_for_name(routes: DataFrame, name: str) -> DataFrame:
    wanted = text.canonical_route(F.lit(name))
    return routes.where(F.col("canonical_route_name") == wanted).select("route_id").orderBy("route_id")
