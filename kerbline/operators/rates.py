"""Historical-rate baseline: smoothed rates on several grains, first grain with data wins."""

from pyspark.sql import DataFrame, functions as F

from kerbline.operators.fallback import first_level

KEYS = ("canonical_route_name", "station_seq", "hour")
# Grains in priority order.
LEVELS = (
    ("route_station_hour", ("canonical_route_name", "station_seq", "hour")),
    ("route_station", ("canonical_route_name", "station_seq")),
    ("route_hour", ("canonical_route_name", "hour")),
    ("hour", ("hour",)),
    ("global", ()),
)
_TYPES = {"canonical_route_name": "string"}
STRATEGY = "time_split_historical_rate_with_laplace_smoothing:route_station_hour->route_station->route_hour->hour->global"


def smoothed_rates(rows: DataFrame, target: str, alpha: float = 1.0) -> DataFrame:
    """(positives + alpha) / (rows + 2 alpha) per level; key columns outside the level are null.

    Rows are first counted on the finest key, so the grouping sets expand counts instead of rows.
    """
    return rates_of(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.sum(target).alias("_pos")), alpha)


def rates_of_cube(cube: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``smoothed_rates`` of a stored count cube (``proxy.count_cube``)."""
    return rates_of(cube.groupBy(*KEYS).agg(F.sum("n").alias("_n"), F.sum("n_full").alias("_pos")), alpha)


def rates_of(fine: DataFrame, alpha: float) -> DataFrame:
    """Rates of all levels from counts ``_n`` and ``_pos`` of the finest keys."""
    # grouping_id sets a bit, first key highest, for every key that is rolled up.
    ids = {name: sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys) for name, keys in LEVELS}
    label = F.lit(None).cast("string")
    for name, gid in ids.items():
        label = F.when(F.grouping_id() == gid, name).otherwise(label)
    sets = [[F.col(k) for k in keys] for _, keys in LEVELS]
    return fine.groupingSets(sets, *KEYS).agg(
        label.alias("level"),
        F.sum("_n").cast("bigint").alias("rate_rows"),
        ((F.sum("_pos") + alpha) / (F.sum("_n") + 2 * alpha)).alias("rate"),
    )


def historical_probability(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``probability`` and ``rate_level`` from the first level that knows the row's key; 0.5 without any history."""
    joined = first_level(rows, rates, LEVELS, KEYS, ("rate",), _TYPES)
    return joined.withColumns(
        {
            "probability": F.coalesce(F.col("_found.rate"), F.lit(0.5)),
            "rate_level": F.coalesce(F.col("_found.level"), F.lit("global")),
        }
    ).drop("_found")
