"""Training, artifacts, scoring, diagnostics and the back-test on the sample city and on labelled sample rows."""

import json

import pytest
from pyspark.sql import functions as F

from kerbline.operators import live
from kerbline.plans import backtest, diagnostics, model, pipeline
from tests import sample_city

FAST = {"maxIter": 5}


@pytest.fixture(scope="module")
def city(spark):
    tables = sample_city.tables(spark)
    rows = pipeline.build_training_set(tables, "target_no_seat_next_station").cache()
    return {**tables, "training": rows}


def test_feature_choice_and_encoding(city):
    rows = city["training"]
    choice = model.choose_features(rows, ["route"])
    assert "route" in choice.excluded and "weather" in choice.included and "canonical_route_name" not in choice.categorical
    gated = model.choose_features(rows.withColumn("weather_imputed", F.lit(1)))
    assert "weather" in gated.excluded and "temperature" not in gated.numeric
    choice = model.choose_features(rows)
    fitted = model.fit(rows, "target_no_seat_next_station", model.logistic(), choice)
    names = model.feature_names(fitted, choice)
    encoded = fitted.transform(rows)
    assert encoded.first()["features"].size == len(names)
    assert abs(encoded.agg(F.avg("z_remain_seat_cnt")).first()[0]) < 1e-9
    assert abs(encoded.agg(F.stddev_pop("z_remain_seat_cnt")).first()[0] - 1) < 1e-9
    unseen = fitted.transform(rows.limit(1).withColumn("canonical_route_name", F.lit("new"))).first()
    assert unseen["v_canonical_route_name"].numNonzeros() == 0
    assert model.top_features(fitted, choice, rows.sparkSession).count() == min(30, len(names))


def test_artifact_round_trip_and_scoring(spark, city, tmp_path):
    path = str(tmp_path / "artifact")
    summary = model.train_artifact(city["training"], path, threshold=0.9, **FAST).first()
    assert (summary["training_rows"], summary["positive_rate"]) == (96, 0.53125)
    artifact = model.load_artifact(spark, path)
    got = model.score(artifact, city["training"])
    assert got.count() == 96
    row = got.first()
    assert row["modelVersion"] == "boosted_full_risk_v1" and row["riskLevel"] in ("high", "watch", "medium", "low")
    assert got.where("fullSeatProbability < 0 OR fullSeatProbability > 1 OR (fullSeatProbability >= 0.9) <> isFullRisk").count() == 0
    assert {r[0] for r in got.select("stationSeqSegment").distinct().collect()} <= {"origin_0_25", "early_mid_25_50", "late_mid_50_75", "terminal_75_100"}
    broken = {k: v for k, v in artifact.meta.items() if k != "threshold"}
    spark.createDataFrame([(json.dumps(broken),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    with pytest.raises(ValueError, match="threshold"):
        model.load_artifact(spark, path)
    with pytest.raises(ValueError):
        model.train_artifact(city["training"].limit(5), path)


def test_report(city):
    got = diagnostics.report(city["training"], **FAST)
    assert [r["variant"] for r in got["ablations"].select("variant").collect()] == [v for v, _ in diagnostics.VARIANTS]
    full = got["ablations"].where("variant = 'full'").first()
    assert full["rows"] == 20 and 0.5 <= full["roc_auc"] <= 1
    assert got["threshold_curve"].count() == 10 and got["calibration"].count() == 10
    assert got["operating_policy"].first()["default_threshold"] == 0.9
    assert got["route_stratified"]["routes"].agg(F.sum("train_rows"), F.sum("test_rows")).first()[:] == (72, 24)
    assert got["calibration_model"]["status"] == "ok" and got["calibration_model"]["sizes"] == {"train": 61, "calibration": 15, "test": 20}
    assert got["calibration_model"]["calibrated_metrics"].first()["rows"] == 20
    assert got["boosting"]["metrics"].first()["rows"] == 20 and got["boosting"]["top_features"].count() > 5


def test_backtest_hides_the_bus_state(city):
    got = backtest.run(city["training"], threshold=0.5, **FAST)
    preds = got["predictions"]
    assert preds.count() == 20 and preds.where("plate_no <> 'scheduled_proxy_backtest'").count() == 0
    assert got["fallback_metrics"].agg(F.sum("rows")).first()[0] == 20
    assert got["confidence_metrics"].agg(F.sum("rows")).first()[0] == 20
    assert got["top_risk_samples"].count() == 20 and got["missed_samples"].where("actual <> 1 OR predicted <> 0").count() == 0
    capped = backtest.run(city["training"], threshold=0.5, max_test_rows=7, **FAST)
    assert capped["predictions"].count() == 7


def test_live_scoring(spark, city, tmp_path):
    path = str(tmp_path / "artifact")
    model.train_artifact(city["training"], path, **FAST)
    from kerbline.sources.schemas import HEADWAY_FIELDS, TIMETABLE_FIELDS

    names = ["routeId"] + TIMETABLE_FIELDS + HEADWAY_FIELDS
    info = {"routeId": "5005001", "upFirstTime": "05:00", "upLastTime": "23:00", "peekAlloc": "20", "nPeekAlloc": "30"}
    tables = {**city, "timetables": spark.createDataFrame([tuple(info.get(n) for n in names)], ", ".join(f"{n} STRING" for n in names))}
    slots = ", ".join(f"predict_time{s} INT, predict_time_sec{s} INT, remain_seat_cnt{s} INT, crowded{s} INT, plate_no{s} STRING, veh_id{s} BIGINT" for s in (1, 2))
    none = (None,) * 6
    data = [
        (1, 228000103, 228000103, 5000001, "5000", 11, 3, None, None, *(5, 300, None, None, "70-101", None), *none),
        (2, 228000103, 228000103, 5005001, "5005", 11, 3, None, None, *none, *none),
        (3, 228000103, 228000103, None, None, None, None, None, None, *none, *none),
    ]
    head = "request_id BIGINT, requested_station_id BIGINT, station_id BIGINT, route_id BIGINT, route_name STRING, route_type_cd INT, sta_order INT, turn_seq INT, flag STRING"
    arrivals = spark.createDataFrame(data, f"{head}, {slots}").withColumn("collected_at", F.lit("2026-05-20T23:30:00Z").cast("timestamp"))
    rows = pipeline.build_live_rows(tables, arrivals, city["snapshots"], city["training"])
    assert {r["request_id"]: r["prediction_mode"] for r in rows.collect()} == {1: "live_vehicle", 2: "schedule_prior", 3: "none"}
    features = pipeline.build_features(tables)
    got = {r["requestId"]: r for r in pipeline.score_live(tables, model.load_artifact(spark, path), rows, pipeline.build_boardings(tables, features)).collect()}
    assert set(got) == {1, 2}
    # Vehicle 70-101 was last seen at stop 5 with no seat; the arrival itself gives none.
    assert (got[1]["stationSeq"], got[1]["remainSeatCnt"], got[1]["featureSource"], got[1]["arrivalSlot"]) == (5, 0, "position_match", 1)
    assert (got[2]["scheduleProxyTimeBasis"], got[2]["scheduleAllocationMinutes"], got[2]["featureSource"]) == ("requested_time", 20, "schedule_historical_proxy")
    diagnostics_ = live.arrival_diagnostics(arrivals).first()
    assert (diagnostics_["arrivals"], diagnostics_["arrival_candidate_slots"], diagnostics_["empty_reason"]) == (3, 1, "arrival_vehicle_fields_present")


def test_passes_read_needed_columns_only(city, monkeypatch):
    """The many passes of a fit run over held columns, which hold all that the model looks at."""
    rows, kept, target = city["training"], [], "target_no_seat_next_station"
    monkeypatch.setattr(diagnostics, "held", lambda frame: kept.append(frame.columns) or frame.persist())
    monkeypatch.setattr(diagnostics, "VARIANTS", (("full", ()),))
    table, full = diagnostics.ablations(rows, target=target)
    assert "station_name" not in kept[0] and "temperature" in kept[0] and target in kept[0]
    assert set(rows.columns) < set(full.columns) and table.first()["rows"] == 20
    choice = model.choose_features(rows)
    assert model.choose_features(model.lean(rows, target)) == choice
    assert model.encoder_stages(rows, choice)[0].getStatement() == model.encoder_stages(model.lean(rows, target), choice)[0].getStatement()
