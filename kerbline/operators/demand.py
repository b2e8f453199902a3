"""Expected boardings per stop, route, weekday and hour."""

from pyspark.sql import Column, DataFrame, functions as F

from kerbline import constants as C
from kerbline.functions import times


def station_daily_average(demand: DataFrame) -> DataFrame:
    return demand.groupBy("station_id").agg(F.coalesce(F.avg("boarding_total"), F.lit(0.0)).alias("station_daily_boarding_avg"))


def route_share(route_stations: DataFrame) -> DataFrame:
    """Each route's equal share of a stop."""
    pairs = route_stations.where("station_id IS NOT NULL AND route_id IS NOT NULL").select("station_id", "route_id").distinct()
    routes = pairs.groupBy("station_id").agg((1.0 / F.count(F.lit(1))).alias("route_share"))
    return pairs.join(routes, "station_id")


def vehicles_per_hour(features: DataFrame) -> DataFrame:
    """Distinct vehicles per (route, weekday, hour), at least the default."""
    pairs = features.select("route_id", "day_of_week", "hour", "veh_id").distinct()
    counts = pairs.groupBy("route_id", "day_of_week", "hour").agg(F.count("veh_id").cast("double").alias("_n"))
    return counts.select(
        "route_id", "day_of_week", "hour", F.greatest("_n", F.lit(C.DEFAULT_VEHICLES_PER_HOUR)).alias("vehicles_per_hour")
    )


def vehicle_bitmaps(features: DataFrame) -> DataFrame:
    """What a set of rows says of its vehicles, in a form that merges: a bitmap of vehicle ids per (route, weekday, hour, id range).

    A group that only knows rows without a vehicle keeps an empty bitmap.
    """
    cells = features.groupBy("route_id", "day_of_week", "hour", F.bitmap_bucket_number("veh_id").alias("id_range"))
    return cells.agg(F.bitmap_construct_agg(F.bitmap_bit_position("veh_id")).alias("vehicles"))


def merge_bitmaps(stored: DataFrame) -> DataFrame:
    """Bitmaps of several sets of rows, in any order and with any overlap, as one of all of them."""
    return stored.groupBy("route_id", "day_of_week", "hour", "id_range").agg(F.bitmap_or_agg("vehicles").alias("vehicles"))


def vehicles_of_bitmaps(stored: DataFrame) -> DataFrame:
    """``vehicles_per_hour`` of merged bitmaps, without a look at the rows."""
    counts = stored.groupBy("route_id", "day_of_week", "hour").agg(F.sum(F.bitmap_count("vehicles")).cast("double").alias("_n"))
    return counts.select(
        "route_id", "day_of_week", "hour", F.greatest("_n", F.lit(C.DEFAULT_VEHICLES_PER_HOUR)).alias("vehicles_per_hour")
    )


def demand_sums(demand: DataFrame) -> DataFrame:
    """Boardings and days per stop, which add up over batches of days."""
    return demand.groupBy("station_id").agg(F.sum("boarding_total").alias("boardings"), F.count("boarding_total").alias("days"))


def merge_demand(stored: DataFrame) -> DataFrame:
    return stored.groupBy("station_id").agg(F.sum("boardings").alias("boardings"), F.sum("days").alias("days"))


def average_of_sums(stored: DataFrame) -> DataFrame:
    """``station_daily_average`` of merged sums."""
    return stored.select("station_id", F.coalesce(F.try_divide("boardings", "days"), F.lit(0.0)).alias("station_daily_boarding_avg"))


def _week_grid() -> Column:
    """All 168 (weekday, hour, ratio) cells as one literal array, to be exploded next to each stop and route."""
    cells = [
        F.struct(F.lit(day).alias("day_of_week"), F.lit(hour).alias("hour"), F.lit(ratio).alias("hour_demand_ratio"))
        for day in range(7)
        for hour, ratio in enumerate(C.HOUR_DEMAND_RATIOS)
    ]
    return F.array(*cells)


def expected_boardings(
    demand: DataFrame, route_stations: DataFrame, features: DataFrame, *, normalise: bool = False
) -> DataFrame:
    """average x hour ratio x route share / vehicles, for stops with demand data.

    ``normalise`` scales the hour ratios to sum to one; off by default, as published they sum to 1.027.
    """
    return boardings_of(station_daily_average(demand), route_stations, vehicles_per_hour(features), normalise=normalise)


def boardings_of(averages: DataFrame, route_stations: DataFrame, vehicles_seen: DataFrame, *, normalise: bool = False) -> DataFrame:
    """``expected_boardings`` from averages and vehicle counts, wherever these come from."""
    cells = route_share(route_stations).join(averages, "station_id")
    grid = cells.select("*", F.inline(_week_grid()))
    if normalise:
        grid = grid.withColumn("hour_demand_ratio", F.col("hour_demand_ratio") / F.lit(sum(C.HOUR_DEMAND_RATIOS)))
    grid = grid.join(vehicles_seen, ["route_id", "day_of_week", "hour"], "left")
    vehicles = F.coalesce("vehicles_per_hour", F.lit(C.DEFAULT_VEHICLES_PER_HOUR))
    expected = (
        F.col("station_daily_boarding_avg") * F.col("hour_demand_ratio") * F.col("route_share") / F.greatest(vehicles, F.lit(1.0))
    )
    return grid.select(
        "station_id",
        "route_id",
        "day_of_week",
        "hour",
        F.bround("station_daily_boarding_avg", 4).alias("station_daily_boarding_avg"),
        "hour_demand_ratio",
        F.bround("route_share", 6).alias("route_share"),
        F.bround(vehicles, 4).alias("vehicles_per_hour"),
        F.bround(expected, 6).alias("expected_boardings_at_stop"),
        F.lit(C.BOARDINGS_FORMULA).alias("source"),
    )


def boardings_summary(boardings: DataFrame, demand: DataFrame, route_stations: DataFrame) -> DataFrame:
    """Rows built, stops with demand, routes with stops."""
    parts = [
        boardings.agg(F.count(F.lit(1)).alias("processed")),
        demand.agg(F.countDistinct("station_id").alias("stations")),
        route_stations.where("station_id IS NOT NULL").agg(F.countDistinct("route_id").alias("routes")),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in ("processed", "stations", "routes")])


def with_boardings_at(requests: DataFrame, boardings: DataFrame, at: str = "at") -> DataFrame:
    """Look up expected boardings for rows of (station, route, instant); null where there is none."""
    wall = times.kst_wall(F.col(at))
    keyed = requests.withColumns({"day_of_week": F.weekday(wall), "hour": F.hour(wall)})
    cells = boardings.select("station_id", "route_id", "day_of_week", "hour", "expected_boardings_at_stop")
    return keyed.join(cells, ["station_id", "route_id", "day_of_week", "hour"], "left")
