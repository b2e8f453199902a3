"""Data-quality profile and summaries."""

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.constants import QUALITY_GROUPS


def null_profile(rows: DataFrame) -> DataFrame:
    """Columns with nulls and how many, counted for all columns in one pass."""
    counted = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])
    long = counted.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count")) for c in rows.columns]))
    )
    return long.where("null_count > 0")


def imputed_rates(features: DataFrame) -> DataFrame:
    """Imputed share per context group; 1 for an empty table."""
    n = F.count(F.lit(1))
    wide = features.agg(
        n.alias("_n"), *[F.coalesce(F.sum(flag), F.lit(0)).alias(group) for group, (flag, _, _) in QUALITY_GROUPS.items()]
    )
    cells = [
        F.struct(
            F.lit(group).alias("feature_group"),
            F.when(F.col("_n") > 0, F.bround(F.col(group) / F.col("_n"), 4)).otherwise(F.lit(1.0)).alias("imputed_rate"),
        )
        for group in QUALITY_GROUPS
    ]
    return wide.select(F.inline(F.array(*cells)))


def feature_recommendation(rates: DataFrame) -> DataFrame:
    """Every context feature with whether its group's imputed share is low enough."""
    per_group = F.create_map(
        *[
            part
            for group, (_, threshold, features) in QUALITY_GROUPS.items()
            for part in (
                F.lit(group),
                F.struct(F.lit(threshold).alias("threshold"), F.array(*map(F.lit, features)).alias("features")),
            )
        ]
    )
    known = rates.withColumn("_group", F.try_element_at(per_group, F.col("feature_group")))
    return known.select(
        "feature_group",
        F.explode("_group.features").alias("feature"),
        (F.col("imputed_rate") <= F.col("_group.threshold")).cast("int").alias("recommended"),
    )


def row_counts(features: DataFrame, column: str) -> DataFrame:
    return features.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))


def report_totals(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("service_date").alias("start_date"),
        F.max("service_date").alias("end_date"),
        F.count_if((F.col("veh_id") == 0) | (F.col("plate_no") == "unknown")).alias("unknown_vehicle_rows"),
    )


def quality_report(features: DataFrame) -> dict[str, DataFrame]:
    rates = imputed_rates(features)
    return {
        "totals": report_totals(features),
        "null_columns": null_profile(features),
        "imputed_rates": rates,
        "route_rows": row_counts(features, "canonical_route_name").orderBy("canonical_route_name"),
        "time_period_rows": row_counts(features, "time_period").orderBy(F.col("row_count").desc(), "time_period"),
        "features": feature_recommendation(rates),
    }


SUMMARY_KEYS = ("service_date", "day_name_ko", "time_period", "canonical_route_name")


def _mean(column: str) -> Column:
    """Mean to two places, halves away from zero; decimal, so that the order of addition cannot flip a half."""
    return F.round(F.avg(column).cast("decimal(20,8)"), 2).cast("double")


def seat_summary(base: DataFrame) -> DataFrame:
    """Seats and low-seat counts per day, period and route."""
    return base.groupBy(*SUMMARY_KEYS).agg(
        F.count(F.lit(1)).alias("observation_count"),
        _mean("remain_seat_cnt").alias("avg_remain_seat_cnt"),
        F.min("remain_seat_cnt").alias("min_remain_seat_cnt"),
        F.max("remain_seat_cnt").alias("max_remain_seat_cnt"),
        F.max("seat_scarcity_score").alias("max_seat_scarcity_score"),
        F.sum("is_no_seat").alias("no_seat_count"),
        F.sum("is_low_seat_2").alias("low_seat_2_count"),
        F.sum("is_low_seat_5").alias("low_seat_5_count"),
    )


def context_summary(features: DataFrame) -> DataFrame:
    """Context averages and imputed counts per day, period and route."""
    return features.groupBy(*SUMMARY_KEYS).agg(
        F.count(F.lit(1)).alias("observation_count"),
        _mean("remain_seat_cnt").alias("avg_remain_seat_cnt"),
        _mean("temperature").alias("avg_temperature"),
        _mean("precipitation").alias("avg_precipitation"),
        _mean("pm10").alias("avg_pm10"),
        _mean("avg_speed").alias("avg_traffic_speed"),
        F.max("event_count").alias("max_event_count"),
        F.max("is_holiday").alias("is_holiday"),
        F.sum("weather_imputed").alias("weather_imputed_count"),
        F.sum("air_quality_imputed").alias("air_quality_imputed_count"),
        F.sum("traffic_imputed").alias("traffic_imputed_count"),
        F.sum("event_imputed").alias("event_imputed_count"),
    )


def route_station_count(routes: DataFrame, route_stations: DataFrame) -> DataFrame:
    """Stops per route, 0 for a route without stops; counted before the join."""
    counts = route_stations.groupBy("route_id").agg(F.count("station_seq").alias("station_count"))
    return routes.join(counts, "route_id", "left").select(
        "route_id", "canonical_route_name", "route_name", F.coalesce("station_count", F.lit(0)).cast("bigint").alias("station_count")
    )
