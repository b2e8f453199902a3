"""Nearest-time join with a tolerance, and the other context look-ups.

Context is matched on the snapshot's Korean hour, so the join runs once per distinct hour (8,760 a year), never per
snapshot: each target hour looks into the hour buckets its tolerance touches, an equi-join, and keeps the closest.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.constants import CONTEXT_TOLERANCE_SECONDS

_HOUR = 3600


def nearest_by_hour(
    hours: DataFrame,
    context: DataFrame,
    fields: Sequence[str],
    *,
    key: str,
    observed: str = "observed_at",
    tolerance_seconds: int = CONTEXT_TOLERANCE_SECONDS,
    by: str | None = None,
) -> DataFrame:
    """For each distinct ``hour_at`` (and ``by``) the closest context row: ``fields`` and ``gap_seconds``.

    Ties go to the earlier time, then the smaller ``key``. Hours with nothing in reach do not appear.
    """
    match = [by] if by else []
    targets = hours.select(*match, F.unix_seconds("hour_at").alias("_at")).distinct()
    # One row per context time is enough when keys are pooled: the smallest key.
    at = F.unix_seconds(observed)
    closest = (
        context.select(*match, at.alias("_obs"), F.col(key).alias("_key"), F.struct(*fields).alias("_row"))
        .groupBy(*match, "_obs")
        .agg(F.min_by("_row", "_key").alias("_row"))
        .withColumn("_bucket", F.floor(F.col("_obs") / _HOUR))
    )
    reach = -(-tolerance_seconds // _HOUR)
    probes = targets.select(
        "*", F.explode(F.sequence(F.floor(F.col("_at") / _HOUR) - reach, F.floor(F.col("_at") / _HOUR) + reach)).alias("_bucket")
    )
    gap = F.abs(F.col("_obs") - F.col("_at"))
    near = probes.join(closest, [*match, "_bucket"]).where(gap <= tolerance_seconds)
    best = near.groupBy(*match, "_at").agg(F.min_by(F.struct("_row", gap.alias("gap")), F.struct(gap, "_obs")).alias("_best"))
    return best.select(
        *match,
        F.timestamp_seconds("_at").alias("hour_at"),
        F.col("_best.gap").alias("gap_seconds"),
        *[F.col(f"_best._row.{f}").alias(f) for f in fields],
    )


def with_nearest(
    rows: DataFrame,
    context: DataFrame,
    defaults: dict[str, object],
    flag: str,
    *,
    key: str,
    by: str | None = None,
    tolerance_seconds: int = CONTEXT_TOLERANCE_SECONDS,
) -> DataFrame:
    """Attach the nearest context to rows with ``hour_at``; ``flag`` is 0 only for an exact hour."""
    found = nearest_by_hour(rows, context, list(defaults), key=key, by=by, tolerance_seconds=tolerance_seconds)
    joined = rows.join(found, ([by] if by else []) + ["hour_at"], "left")
    filled = {name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()}
    imputed = F.when(F.col("gap_seconds") == 0, 0).otherwise(1)
    return joined.withColumns({**filled, flag: imputed}).drop("gap_seconds")


def with_holiday(rows: DataFrame, holidays: DataFrame) -> DataFrame:
    """Left join on the service date; a day that is not listed is no holiday."""
    listed = holidays.groupBy("service_date").agg(
        F.max("is_holiday").alias("is_holiday"), F.min("holiday_name").alias("holiday_name")
    )
    joined = rows.join(listed, "service_date", "left")
    return joined.withColumns(
        {
            "is_holiday": F.coalesce("is_holiday", F.lit(0)).cast("int"),
            "holiday_name": F.coalesce("holiday_name", F.lit("")),
        }
    )


def with_event(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Left join on the exact date, one event row per date (smallest area key first)."""
    per_day = events.groupBy("service_date").agg(
        F.min_by(F.struct("event_count", "event_nearby_count"), "area_key").alias("_event")
    )
    joined = rows.join(per_day, "service_date", "left")
    return joined.withColumns(
        {
            "event_count": F.coalesce(F.col("_event.event_count"), F.lit(0)).cast("int"),
            "event_nearby_count": F.coalesce(F.col("_event.event_nearby_count"), F.lit(0)).cast("int"),
            "event_imputed": F.col("_event").isNull().cast("int"),
        }
    ).drop("_event")


def day_type(wall: Column, is_holiday: Column) -> Column:
    """weekday, saturday or sunday_holiday."""
    weekday = F.weekday(wall)
    return F.when((is_holiday == 1) | (weekday == 6), "sunday_holiday").when(weekday == 5, "saturday").otherwise("weekday")
