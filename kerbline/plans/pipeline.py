"""The batch pipeline over stored tables: snapshots to features, labels, boardings, training set and risk scores."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from kerbline.operators import demand, features, labels, live, proxy, schedule, training
from kerbline.plans import model as M

CONTEXT = ("weather", "air", "traffic", "holidays", "events")


def build_features(tables: Mapping[str, DataFrame]) -> DataFrame:
    base = features.location_features(tables["snapshots"], tables["routes"], tables["stops"])
    return features.model_features(base, *[tables[name] for name in CONTEXT])


def build_labels(model_rows: DataFrame, **options) -> DataFrame:
    return labels.label_table(model_rows, micros=F.unix_micros("collected_at"), **options)


def build_boardings(tables: Mapping[str, DataFrame], model_rows: DataFrame) -> DataFrame:
    return demand.expected_boardings(tables["demand"], tables["stops"], model_rows)


def build_training_set(tables: Mapping[str, DataFrame], target: str | None = None, **options) -> DataFrame:
    rows = build_features(tables)
    return training.training_set(rows, build_labels(rows, **options), build_boardings(tables, rows), target)


def build_live_rows(tables: Mapping[str, DataFrame], arrivals: DataFrame, positions: DataFrame, history: DataFrame) -> DataFrame:
    """Rows to score for all requests of a poll: live vehicles, else timetable proxies, else a ``none`` row.

    ``history`` holds past feature rows with their labels. Context is attached once for all rows of the poll.
    """
    return build_slot_rows(tables, arrivals, live.with_position(live.arrival_slots(arrivals), positions), history)


def build_slot_rows(tables: Mapping[str, DataFrame], arrivals: DataFrame, slots: DataFrame, history: DataFrame) -> DataFrame:
    """As ``build_live_rows``, from usable slots whose vehicles' positions are known as ``_seen``."""
    seen = live.rows_of_slots(slots.where("route_id IS NOT NULL"), tables["snapshots"], tables["routes"], tables["stops"])
    known = proxy.proxy_statistics(history, "target_no_seat_next_station", require_next_station=True)
    requests = live.without_live(arrivals, slots).withColumn("at", F.col("collected_at"))
    prior = live.scheduled_rows(
        requests, schedule.timetable(tables["timetables"]), tables["holidays"], tables["routes"], tables["stops"], known, tables["snapshots"]
    )
    return live.choose_rows(arrivals, seen, prior)


def score_live(tables: Mapping[str, DataFrame], artifact: M.Artifact, rows: DataFrame, boardings: DataFrame) -> DataFrame:
    """Attach context and expected boardings to live rows and score them; ``none`` rows pass unscored by themselves."""
    usable = rows.where("prediction_mode <> 'none'")
    kept = [c for c in M.LIVE_CONTEXT + ("request_id",) if c in rows.columns and c not in ("service_date", "day_name_ko", "is_holiday", "holiday_name")]
    full = features.model_features(usable, *[tables[name] for name in CONTEXT], keep=kept)
    return M.score(artifact, training.with_boardings(full, boardings))
