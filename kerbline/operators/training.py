"""Training set, prediction input and their filters."""

from pyspark.sql import DataFrame, functions as F

from kerbline.constants import TARGET_FLAGS


def target_flag(target: str) -> str | None:
    if target not in TARGET_FLAGS:
        raise ValueError(f"unknown target {target}; one of {', '.join(sorted(TARGET_FLAGS))}")
    return TARGET_FLAGS[target]


def with_boardings(features: DataFrame, boardings: DataFrame) -> DataFrame:
    """Expected boardings of the row's stop, route, weekday and hour; 0 and a flag where there are none."""
    key = ["station_id", "route_id", "day_of_week", "hour"]
    joined = features.join(boardings.select(*key, "expected_boardings_at_stop"), key, "left")
    return joined.withColumns(
        {
            "expected_boardings_missing": F.col("expected_boardings_at_stop").isNull().cast("int"),
            "expected_boardings_at_stop": F.coalesce("expected_boardings_at_stop", F.lit(0.0)),
        }
    )


def training_set(
    features: DataFrame,
    labels: DataFrame,
    boardings: DataFrame,
    target: str | None = None,
    *,
    exact_weather_only: bool = False,
) -> DataFrame:
    """Features with labels; with a target only the rows whose future for it was seen."""
    flag = target_flag(target) if target else None
    if flag:
        labels = labels.where(F.col(flag) == 1)
    if exact_weather_only:
        features = features.where("weather_imputed = 0")
    return with_boardings(features.join(labels, "snapshot_id"), boardings)


def prediction_rows(
    features: DataFrame,
    boardings: DataFrame,
    *,
    limit: int = 20,
    snapshot_id: int | None = None,
    at_kst: str | None = None,
    route_name: str | None = None,
    station_id: int | None = None,
    station_name: str | None = None,
    remain_seat_cnt: int | None = None,
) -> DataFrame:
    """Latest rows that equal every given value; the filters reach the scan."""
    wanted = {
        "snapshot_id": snapshot_id,
        "collected_at_kst": kst_filter_text(at_kst) if at_kst else None,
        "canonical_route_name": route_name or None,
        "station_id": station_id,
        "station_name": station_name or None,
        "remain_seat_cnt": remain_seat_cnt,
    }
    for name, value in wanted.items():
        if value is not None:
            features = features.where(F.col(name) == F.lit(value))
    return with_boardings(latest_rows(features, limit), boardings)


def kst_filter_text(value: str) -> str:
    """Normalise a user's time to the stored ``yyyy-MM-ddTHH:mm:ss+09:00`` form."""
    text = value.strip()
    if "T" not in text:
        text = text.replace(" ", "T", 1)
    return text if "+" in text or text.endswith("Z") else f"{text}+09:00"


def latest_rows(features: DataFrame, limit: int = 20) -> DataFrame:
    return features.orderBy(F.col("collected_at").desc(), F.col("snapshot_id").desc()).limit(max(1, limit))


def coverage(features: DataFrame, day: str | None = None) -> DataFrame:
    """What data there is, for an empty prediction: total, first and last time, rows on the asked day."""
    columns = [
        F.count(F.lit(1)).alias("total_rows"),
        F.min("collected_at_kst").alias("min_collected_at_kst"),
        F.max("collected_at_kst").alias("max_collected_at_kst"),
    ]
    if day:
        columns.append(F.count_if(F.col("collected_at_kst").startswith(day)).alias("requested_date_rows"))
    return features.agg(*columns)
