"""Bus-state proxies from history: statistics on nine grains, first grain with data wins."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.functions import seats
from kerbline.operators.fallback import first_level, level_cell

KEYS = ("canonical_route_name", "station_id", "station_seq", "hour", "is_weekend", "is_holiday")
# Grains in priority order.
LEVELS = (
    ("route_station_hour_daytype", ("canonical_route_name", "station_id", "hour", "is_weekend", "is_holiday")),
    ("route_station_adjacent_hour_daytype", ("canonical_route_name", "station_id", "hour", "is_weekend", "is_holiday")),
    ("route_station_hour", ("canonical_route_name", "station_id", "hour")),
    ("route_station_daytype", ("canonical_route_name", "station_id", "is_weekend", "is_holiday")),
    ("route_station", ("canonical_route_name", "station_id")),
    ("route_station_seq_hour", ("canonical_route_name", "station_seq", "hour")),
    ("route_hour", ("canonical_route_name", "hour")),
    ("route", ("canonical_route_name",)),
    ("hour", ("hour",)),
)
_TYPES = {"canonical_route_name": "string"}


def _on_all_levels(counted: DataFrame) -> DataFrame:
    """One output row per level (the adjacent-hour level counts a row in hours h-1, h and h+1)."""
    cells = []
    for level, keys in LEVELS:
        if level != "route_station_adjacent_hour_daytype":
            cells.append(level_cell(level, keys, KEYS, _TYPES))
    cells = F.array(*cells)
    for shift in (-1, 0, 1):
        hour = F.col("hour") + shift
        near = F.array(level_cell(*LEVELS[1], KEYS, _TYPES, hour=hour))
        cells = F.concat(cells, F.when(hour.between(0, 23), near).otherwise(F.slice(near, 1, 0)))
    values = [c for c in counted.columns if c not in KEYS]
    return counted.select(*values, F.explode(cells).alias("_at")).select("_at.*", *values)


def proxy_statistics(history: DataFrame, target: str, *, require_next_station: bool = False) -> DataFrame:
    """Per level and key: rows, full rates, upper-median seats, smallest-mode crowding, upper-median capacity.

    Rows are first counted on the finest key and their (small) value domain, which shrinks them before the levels
    multiply them. The upper median ``sorted[n // 2]`` is the smallest value whose running count exceeds ``n // 2``,
    so no group is ever collected. ``require_next_station`` rates the target only over rows with a next stop.
    """
    return statistics_of(count_cube(history, target, require_next_station=require_next_station))


def count_cube(history: DataFrame, target: str, *, require_next_station: bool = False) -> DataFrame:
    """Counts per finest key and observed values, from which all levels' statistics and rates follow.

    Cubes of several sets of rows that don't overlap add up (``merge_cubes``), so a new day costs its own rows.
    """
    rated = (F.col("has_next_station") == 1) if require_next_station else F.col(target).isNotNull()
    return history.groupBy(*KEYS, "remain_seat_cnt", "crowded", "estimated_capacity").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(rated).alias("n_rated"),
        F.coalesce(F.sum(F.when(rated, F.col(target))), F.lit(0)).alias("n_next_full"),
        F.sum(target).alias("n_full"),
    )


def merge_cubes(stored: DataFrame) -> DataFrame:
    counts = ("n", "n_rated", "n_next_full", "n_full")
    return stored.groupBy(*[c for c in stored.columns if c not in counts]).agg(*[F.sum(c).alias(c) for c in counts])


def statistics_of(cube: DataFrame) -> DataFrame:
    """``proxy_statistics`` of a merged cube."""
    counted = cube.drop("n_full")
    # The hash leads the keys only to make sorting by them cheap: it nearly always decides a comparison at once.
    leveled = _on_all_levels(counted).withColumn("_hash", F.xxhash64("level", *KEYS))
    keys = ["_hash", "level", *KEYS]
    values = F.array(
        *[
            F.struct(F.lit(stat).alias("stat"), F.col(column).cast("bigint").alias("value"), valid.alias("valid"))
            for stat, column, valid in (
                ("seats", "remain_seat_cnt", F.coalesce(F.col("remain_seat_cnt") >= 0, F.lit(False))),
                ("crowded", "crowded", F.col("crowded").isNotNull()),
                ("capacity", "estimated_capacity", F.coalesce(F.col("estimated_capacity") > 0, F.lit(False))),
            )
        ]
    )
    long = (
        leveled.select(*keys, "n", "n_rated", "n_next_full", F.inline(values))
        .groupBy(*keys, "stat", "value", "valid")
        .agg(F.sum("n").alias("n"), F.sum("n_rated").alias("n_rated"), F.sum("n_next_full").alias("n_next_full"))
    )
    # By now a key holds one row per distinct value; partitioned on the key alone, windows and totals share the shuffle.
    long = long.repartition(*keys)
    domain = Window.partitionBy(*keys, "stat", "valid")
    long = long.withColumns({"upto": F.sum("n").over(domain.orderBy("value")), "total": F.sum("n").over(domain)})

    def median(stat):
        past_half = (F.col("stat") == stat) & F.col("valid") & (F.col("upto") > F.floor(F.col("total") / 2))
        return F.min(F.when(past_half, F.col("value")))

    seats_rows = F.col("stat") == "seats"
    most = F.max(F.when((F.col("stat") == "crowded") & F.col("valid"), F.struct("n", (-F.col("value")).alias("v"))))
    rows = F.sum(F.when(seats_rows, F.col("n")))
    rated_rows = F.sum(F.when(seats_rows, F.col("n_rated")))
    return long.groupBy(*keys).agg(
        rows.cast("bigint").alias("historical_proxy_rows"),
        F.bround(F.try_divide(F.sum(F.when(seats_rows, F.col("n_next_full"))), rated_rows), 6).alias("historical_next_station_full_rate"),
        F.bround(F.sum(F.when(seats_rows & (F.col("value") == 0), F.col("n")).otherwise(0)) / rows, 6).alias("historical_now_full_rate"),
        median("seats").alias("proxy_remain_seat_cnt"),
        (-most["v"]).alias("proxy_crowded"),
        median("capacity").alias("proxy_capacity"),
    ).drop("_hash")


STATISTICS = (
    "historical_proxy_rows", "historical_next_station_full_rate", "historical_now_full_rate",
    "proxy_remain_seat_cnt", "proxy_crowded", "proxy_capacity",
)


def with_proxy(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """Attach the statistics of the first level that knows the row's key, and that level's name."""
    joined = first_level(rows, statistics, LEVELS, KEYS, STATISTICS, _TYPES)
    return joined.withColumns(
        {
            "historical_proxy_group": F.coalesce(F.col("_found.level"), F.lit("none")),
            **{s: F.col(f"_found.{s}") for s in STATISTICS},
            "historical_proxy_rows": F.coalesce(F.col("_found.historical_proxy_rows"), F.lit(0).cast("bigint")),
            "proxy_remain_source": F.when(F.col("_found").isNull(), "default_capacity").otherwise("historical_median"),
        }
    ).drop("_found")


def hide_bus_state(rows: DataFrame, capacity_fallback: Column, plate: str) -> DataFrame:
    """Replace the observed bus state by the attached proxy and recompute what depends on it."""
    capacity = F.coalesce(
        F.when(F.col("proxy_capacity") > 0, F.col("proxy_capacity")), F.when(capacity_fallback > 0, capacity_fallback), F.lit(45)
    ).cast("int")
    rows = rows.withColumns({"plate_no": F.lit(plate), "estimated_capacity": capacity})
    rows = rows.withColumns(
        {
            "remain_seat_cnt": F.coalesce("proxy_remain_seat_cnt", "estimated_capacity").cast("int"),
            "crowded": F.coalesce("proxy_crowded", F.lit(0)).cast("int"),
        }
    )
    return rows.withColumns(
        {
            "crowded_label": F.coalesce(seats.crowded_label(F.col("crowded")), F.lit("unknown")),
            "seat_scarcity_score": seats.scarcity(F.col("remain_seat_cnt"), F.col("estimated_capacity")),
            **seats.seat_flags(F.col("remain_seat_cnt")),
        }
    )
