"""CSV, JSON and Parquet outputs. Files are written in parallel; row order across parts follows part order."""

from pyspark.sql import DataFrame, SparkSession, functions as F

LOCATION_ORDER = ("collected_at_kst", "canonical_route_name", "station_seq", "veh_id")
MODEL_ORDER = ("observed_hour_kst", "canonical_route_name", "station_seq", "veh_id")
BOARDINGS_ORDER = ("route_id", "station_id", "day_of_week", "hour")
TRAINING_ORDER = ("collected_at_kst", "canonical_route_name", "station_seq", "snapshot_id")


def write_csv(rows: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """Header-named CSV in the given order (a range-partitioned sort, one file per part)."""
    ordered = rows.orderBy(*order) if order else rows
    ordered.write.mode("overwrite").option("header", True).csv(path)


def export_location_features(rows: DataFrame, path: str) -> None:
    write_csv(rows, path, LOCATION_ORDER)


def export_model_features(rows: DataFrame, path: str) -> None:
    write_csv(rows, path, MODEL_ORDER)


def export_boardings(rows: DataFrame, path: str) -> None:
    write_csv(rows, path, BOARDINGS_ORDER)


def export_training_set(rows: DataFrame, path: str) -> None:
    write_csv(rows, path, TRAINING_ORDER)


def export_table(spark: SparkSession, table: str, path: str) -> None:
    write_csv(spark.table(table), path)


def export_query(spark: SparkSession, query: str, path: str) -> None:
    write_csv(spark.sql(query), path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add a run's metrics to its history: the scalar columns and all of them as one JSON text."""
    scalars = [f.name for f in metrics.schema.fields if f.dataType.simpleString() in ("string", "int", "bigint", "double", "boolean")]
    row = metrics.withColumn("metrics_json", F.to_json(F.struct(*metrics.columns))).select(*scalars, "metrics_json")
    row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)
