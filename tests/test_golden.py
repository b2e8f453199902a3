"""The sample city end to end: known totals, quality report and baseline metrics."""

import pytest
from pyspark.sql import functions as F

from kerbline.operators import demand, features, labels, quality, training
from kerbline.plans import baseline, pipeline
from tests import sample_city


@pytest.fixture(scope="module")
def city(spark):
    tables = sample_city.tables(spark)
    rows = pipeline.build_features(tables).cache()
    return {**tables, "features": rows, "labels": pipeline.build_labels(rows).cache(), "boardings": pipeline.build_boardings(tables, rows).cache()}


def test_totals(city):
    assert city["features"].count() == 128
    assert city["labels"].count() == 128
    assert city["boardings"].count() == 8064
    assert labels.label_summary(city["labels"]).first()["has_next_station"] == 96
    assert demand.boardings_summary(city["boardings"], city["demand"], city["stops"]).first().asDict() == {"processed": 8064, "stations": 6, "routes": 8}
    assert {r["station_count"] for r in quality.route_station_count(city["routes"], city["stops"]).collect()} == {6}


def test_quality_report(city):
    report = quality.quality_report(city["features"])
    totals = report["totals"].first()
    assert (totals["total_rows"], str(totals["start_date"]), str(totals["end_date"])) == (128, "2026-05-21", "2026-05-22")
    assert report["null_columns"].count() == 0
    assert {r["feature_group"]: r["imputed_rate"] for r in report["imputed_rates"].collect()} == {
        "weather": 0.0, "airQuality": 0.0625, "traffic": 0.0625, "event": 0.0,
    }
    assert {r["row_count"] for r in report["route_rows"].collect()} == {16}
    assert {r["time_period"]: r["row_count"] for r in report["time_period_rows"].collect()} == {"morning_peak": 80, "evening_peak": 40, "late_night": 8}
    assert all(r["recommended"] == 1 for r in report["features"].collect())


def test_baseline_metrics(city):
    rows = training.training_set(city["features"], city["labels"], city["boardings"], "target_no_seat_next_station")
    got = baseline.evaluate(rows).first().asDict()
    want = {
        "total_rows": 96, "train_rows": 76, "test_rows": 20, "positive_rate": 0.53125, "accuracy": 0.65, "precision": 0.588235, "recall": 1.0,
        "f1": 0.740741, "roc_auc": 0.8, "brier_score": 0.190625, "top_decile_precision": 0.5,
    }
    assert {k: got[k] for k in want} == want


def test_summaries(city):
    base = features.location_features(city["snapshots"], city["routes"], city["stops"])
    row = quality.seat_summary(base).where("time_period = 'evening_peak' AND canonical_route_name = '5001-1A'").first()
    assert (row["observation_count"], row["avg_remain_seat_cnt"], row["max_seat_scarcity_score"], row["no_seat_count"], row["low_seat_2_count"], row["low_seat_5_count"]) == (5, 6.6, 100, 1, 2, 3)
    row = quality.context_summary(city["features"]).where("time_period = 'evening_peak' AND canonical_route_name = '5000'").first()
    assert (row["avg_remain_seat_cnt"], row["avg_temperature"], row["avg_precipitation"], row["avg_pm10"], row["avg_traffic_speed"], row["max_event_count"]) == (9.4, 22.4, 1.2, 56.0, 24.7, 2)
    # A day listed with 0 is no holiday, and an event count of 0 stays 0.
    assert row["is_holiday"] == 0
    assert city["features"].where("service_date = '2026-05-22'").agg(F.max("event_count")).first()[0] == 0


def test_as_of_capacity_never_exceeds_all_time(city):
    now = features.location_features(city["snapshots"], city["routes"], city["stops"], as_of=True).select("snapshot_id", F.col("estimated_capacity").alias("a"))
    ever = features.location_features(city["snapshots"], city["routes"], city["stops"]).select("snapshot_id", F.col("estimated_capacity").alias("b"))
    assert now.join(ever, "snapshot_id").where("a > b").count() == 0
    assert now.count() == 128
