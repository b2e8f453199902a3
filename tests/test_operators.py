"""Operators on small fixtures and against brute force on skewed data."""

import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import demand, features, labels, live, metrics, nearest, proxy, ranking, split
from kerbline.plans import pipeline
from kerbline.sources import context
from tests import sample_city

SNAPSHOT = (
    "snapshot_id BIGINT, at STRING, route_id BIGINT, veh_id BIGINT, plate_no STRING, station_id BIGINT, station_seq INT, remain_seat_cnt INT, crowded INT, route_type_cd INT"
)


def shots(rows, data):
    frame = rows(data, SNAPSHOT).withColumn("collected_at", F.col("at").cast("timestamp")).drop("at")
    return frame.withColumns({"low_plate": F.lit(0), "state_cd": F.lit(1), "tagless_cd": F.lit(0), "raw_json": F.lit(None).cast("string")})


@pytest.fixture
def tables(spark):
    return sample_city.tables(spark)


@pytest.fixture
def one_route(rows):
    return rows([(1, "5000", "5000", 11, "express")], "route_id BIGINT, route_name STRING, canonical_route_name STRING, route_type_cd INT, route_type_name STRING")


def test_base_features(rows, tables, one_route):
    base = features.location_features(shots(rows, [(1, "2026-05-20T23:05:00+00:00", 1, 10, "A", 100, 10, 2, 3, 11)]), one_route, tables["stops"])
    got = base.first()
    assert (got["collected_at_kst"], got["day_name_ko"], got["time_bucket_10m"], got["time_period"]) == ("2026-05-21T08:05:00+09:00", "목", "08:00", "morning_peak")
    assert (got["seat_scarcity_score"], got["is_low_seat_2"], got["is_no_seat"], got["raw_json"]) == (93, 1, 0, "{}")


@pytest.mark.parametrize("at,temperature,text_known", [("2026-05-20T23:05:00+00:00", 16.0, True), ("2026-05-21T10:00:00+00:00", 0.0, False)])
def test_nearest_and_stale_context(spark, rows, tables, one_route, at, temperature, text_known):
    weather = rows([("119", "2026-05-21 07:00", "16.0")], "stnId STRING, tm STRING, ta STRING")
    none = {n: tables[n].limit(0) for n in ("air", "traffic", "events", "holidays")}
    base = features.location_features(shots(rows, [(1, at, 1, 10, None, None, None, 5, None, 11)]), one_route, tables["stops"])
    built = features.model_features(base, context.weather(weather, F.lit("t")), none["air"], none["traffic"], none["holidays"], none["events"])
    got = built.first().asDict()
    assert got["temperature"] == temperature and (got["weather_text"] != "unknown") is text_known
    assert (got["weather_imputed"], got["air_quality_imputed"], got["traffic_imputed"], got["event_imputed"]) == (1, 1, 1, 1)
    assert all(v is not None for v in got.values())
    assert (got["plate_no"], got["veh_id"], got["remain_seat_cnt"]) == ("unknown", 10, 5)


def future_rows(rows, data):
    frame = rows(data, "snapshot_id BIGINT, route_id BIGINT, veh_id BIGINT, plate_no STRING, sec BIGINT, station_seq INT, remain INT")
    return frame.withColumns(
        {
            "is_no_seat": (F.col("remain") == 0).cast("int"),
            "is_low_seat_2": (F.col("remain") <= 2).cast("int"),
            "is_low_seat_5": (F.col("remain") <= 5).cast("int"),
        }
    )


def test_labels_small(rows):
    got = labels.label_table(
        future_rows(rows, [(1, 1, 10, "A", 0, 1, 3), (2, 1, 10, "A", 240, 2, 0)]), micros=F.col("sec") * 1_000_000
    ).orderBy("snapshot_id").collect()
    assert (got[0]["target_no_seat_next_5min"], got[0]["target_no_seat_next_station"], got[0]["has_next_station"]) == (1, 1, 1)
    assert (got[1]["has_future_5min"], got[1]["has_next_station"], got[1]["target_no_seat_now"]) == (0, 0, 1)


def test_next_stop_too_late(rows):
    got = labels.label_table(future_rows(rows, [(1, 1, 1, "A", 0, 1, 3), (2, 1, 1, "A", 7200, 2, 0)]), micros=F.col("sec") * 1_000_000)
    assert got.agg(F.sum("has_next_station"), F.sum("target_no_seat_next_station")).first()[:] == (0, 0)


def test_one_stop_sequence_has_no_next_stop(rows):
    got = labels.label_table(future_rows(rows, [(1, 1, 1, "A", 0, 4, 3), (2, 1, 1, "A", 60, 4, 0)]), micros=F.col("sec") * 1_000_000)
    assert got.agg(F.sum("has_next_station"), F.sum("has_future_5min")).first()[:] == (0, 1)


def test_horizon_bounds(rows):
    data = [(1, 1, 1, "A", 0, 1, 9), (2, 1, 1, "A", 240, 2, 9), (3, 1, 1, "A", 240, 3, 9), (4, 1, 1, "A", 240, 1, 9), (5, 1, 1, "A", 7200, 3, 9)]
    got = {r["row_id"]: r for r in labels.vehicle_futures(future_rows(rows, data), micros=F.col("sec") * 1_000_000).collect()}
    assert got[1]["_h_5min"]["row_id"] == 3 and got[1]["_next"]["row_id"] == 2
    assert got[4]["_h_5min"] is None and got[4]["_next"]["row_id"] == 2


@pytest.mark.parametrize("slice_seconds", [None, 600, 100_000])
def test_futures_match_brute_force_on_a_hot_vehicle(rows, slice_seconds):
    rng = random.Random(5)
    data = []
    for i in range(900):
        hot = i % 3 == 0
        data.append((i, 1, None if hot else rng.randrange(40), None if hot else "p", rng.randrange(0, 4000), rng.randrange(-3, 300), rng.randrange(4)))
    horizons, reach = (("5min", 60), ("10min", 200)), 500
    got = labels.vehicle_futures(
        future_rows(rows, data), micros=F.col("sec") * 1_000_000, horizons=horizons, next_stop_seconds=reach, slice_seconds=slice_seconds
    ).collect()
    assert len(got) == len(data)
    by_key = {}
    for d in data:
        by_key.setdefault(d[1:4], []).append(d)
    for r in got:
        me = data[r["row_id"]]
        others = by_key[me[1:4]]
        for name, seconds in horizons:
            inside = [o for o in others if me[4] < o[4] <= me[4] + seconds]
            want = max(inside, key=lambda o: (o[4], o[5], o[0]))[0] if inside else None
            assert (r[f"_h_{name}"]["row_id"] if r[f"_h_{name}"] else None) == want
        later = [o for o in others if me[4] <= o[4] <= me[4] + reach and o[5] > me[5]]
        want = min(later, key=lambda o: (o[4], o[5], o[0]))[0] if later else None
        assert (r["_next"]["row_id"] if r["_next"] else None) == want


def test_label_plan_has_one_shuffle(rows):
    frame = labels.label_table(future_rows(rows, [(1, 1, 1, "A", 0, 1, 3)]), micros=F.col("sec") * 1_000_000, seq_bounds=(0, 200))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_nearest_matches_brute_force(rows):
    rng = random.Random(1)
    targets = [(i, 3600 * rng.randrange(0, 400)) for i in range(300)]
    ctx = [(str(i % 3), rng.randrange(0, 400 * 3600), i) for i in range(60)]
    hours = rows(targets, "id INT, sec BIGINT").withColumn("hour_at", F.timestamp_seconds("sec"))
    known = rows(ctx, "key STRING, sec BIGINT, v INT").withColumn("observed_at", F.timestamp_seconds("sec"))
    got = nearest.with_nearest(hours, known, {"v": -1}, "imputed", key="key").collect()
    for r in got:
        inside = [c for c in ctx if abs(c[1] - r["sec"]) <= 3 * 3600]
        best = min(inside, key=lambda c: (abs(c[1] - r["sec"]), c[1], c[0])) if inside else None
        assert r["v"] == (best[2] if best else -1)
        assert r["imputed"] == (0 if best and best[1] == r["sec"] else 1)


def skewed(rows, n=2000):
    """A third of all rows in one group at one time with one score."""
    rng = random.Random(3)
    data = []
    for i in range(n):
        if i % 3 == 0:
            data.append((i, "hot", 5_000_000_000, 0.5, rng.randrange(2)))
        else:
            data.append((i, f"g{i % 7}", rng.randrange(10**10), rng.randrange(1000) / 1000, rng.randrange(2)))
    return data, rows(data, "row_id BIGINT, g STRING, t BIGINT, probability DOUBLE, actual INT")


def test_splits_match_sorting(rows):
    data, frame = skewed(rows)
    got = {r["row_id"]: r["split"] for r in split.chronological_split(frame, F.col("t"), F.col("row_id")).collect()}
    ordered = sorted(data, key=lambda d: (d[2], d[0]))
    assert [got[d[0]] for d in ordered] == ["train"] * 1600 + ["test"] * 400
    cut = split.chronological_cut(frame, F.col("t"), F.col("row_id"))
    assert (cut["micros"], cut["row_id"], cut["train"]) == (ordered[1599][2], ordered[1599][0], 1600)
    got = {r["row_id"]: r["split"] for r in split.grouped_split(frame, "g", F.col("t"), F.col("row_id")).collect()}
    for g in {d[1] for d in data}:
        mine = [got[d[0]] for d in ordered if d[1] == g]
        assert mine == ["train"] * int(len(mine) * 0.8) + ["test"] * (len(mine) - int(len(mine) * 0.8))
    parts = split.three_way_split(frame, F.col("t"), F.col("row_id")).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 1280, "calibration": 320, "test": 400}


def test_single_row_groups_are_skipped(rows):
    frame = rows([(1, "a", 1), (2, "b", 1), (3, "b", 2)], "row_id BIGINT, g STRING, t BIGINT")
    got = {r["row_id"]: r["split"] for r in split.grouped_split(frame, "g", F.col("t"), F.col("row_id")).collect()}
    assert got == {1: "skipped", 2: "train", 3: "test"}


def test_rows_without_a_group_stay(rows):
    data = rows([(i, i, None if i % 2 else "g") for i in range(20)], "id BIGINT, t BIGINT, g STRING")
    got = split.grouped_split(data, "g", F.col("t"), F.col("id")).collect()
    assert sorted(r["id"] for r in got) == list(range(20))
    assert sorted(r["id"] for r in got if r["split"] == "test") == [16, 17, 18, 19]


def test_cut_keys_with_ids_beyond_one_run(rows):
    data = [(i * 3_000_000, 7) for i in range(50)]
    frame = rows(data, "row_id BIGINT, t BIGINT")
    cut = ranking.cut_keys(frame, [], ranking.time_levels(F.col("t"), F.col("row_id")), lambda n: F.lit(33)).first()
    assert cut["cut"][4] == data[32][0]


def brute_auc(pairs):
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    if not pos or not neg:
        return 0.5
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_metrics_match_brute_force(rows):
    data, frame = skewed(rows, 900)
    got = {r["group"]: r for r in metrics.group_metrics(frame, "g", 0.4).collect()}
    for g in {d[1] for d in data}:
        mine = [d for d in data if d[1] == g]
        assert abs(got[g]["roc_auc"] - brute_auc([(d[3], d[4]) for d in mine])) < 1e-6
        top = sorted(mine, key=lambda d: (-d[3], d[2], d[0]))[: max(1, -(-len(mine) // 10))]
        assert abs(got[g]["top_decile_precision"] - sum(d[4] for d in top) / len(top)) < 1e-6
        assert abs(got[g]["accuracy"] - sum((d[3] >= 0.4) == (d[4] == 1) for d in mine) / len(mine)) < 1e-6


def test_metrics_of_one_class(rows):
    frame = rows([(1, 1, 0.2, 1), (2, 2, 0.9, 1)], "row_id BIGINT, t BIGINT, probability DOUBLE, actual INT")
    got = metrics.classification_metrics(frame, 0.5).first()
    assert (got["roc_auc"], got["recall"], got["precision"], got["top_decile_precision"]) == (0.5, 0.5, 1.0, 1.0)


def test_calibration_reports_empty_bins(rows):
    frame = rows([(0.05, 0), (0.95, 1), (1.0, 1)], "probability DOUBLE, actual INT")
    got = metrics.calibration_bins(frame).orderBy("bin_index").collect()
    assert [r["rows"] for r in got] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 2]
    assert abs(metrics.calibration_error(frame).first()[0] - (0.05 + 0.025 * 2) / 3) < 1e-6


def test_upper_median_and_smallest_mode(rows):
    base = [("r", 1, 1, 8, 0, 0)]
    data = [(*base[0], seats, crowd, 45, 1, 1) for seats, crowd in zip((1, 2, 3, 4, -1, -1), (1, 1, 3, 3, 5, 9))]
    frame = rows(
        data,
        "canonical_route_name STRING, station_id BIGINT, station_seq INT, hour INT, is_weekend INT, is_holiday INT, remain_seat_cnt INT, crowded INT, estimated_capacity INT, y INT, has_next_station INT",
    )
    got = proxy.proxy_statistics(frame, "y").where("level = 'route'").first()
    assert (got["proxy_remain_seat_cnt"], got["proxy_crowded"], got["proxy_capacity"], got["historical_proxy_rows"]) == (3, 1, 45, 6)


def test_proxy_falls_back_level_by_level(rows):
    schema = (
        "canonical_route_name STRING, station_id BIGINT, station_seq INT, hour INT, is_weekend INT, is_holiday INT, remain_seat_cnt INT, crowded INT, estimated_capacity INT, y INT, has_next_station INT"
    )
    history = rows([("r", 1, 4, 8, 0, 0, 10, 2, 45, 0, 1), ("q", 9, 1, 22, 1, 0, 3, 3, 45, 1, 0)], schema)
    known = proxy.proxy_statistics(history, "y", require_next_station=True)
    probes = [
        (0, "r", 1, 4, 8, 0, 0, "route_station_hour_daytype"), (1, "r", 1, 4, 9, 0, 0, "route_station_adjacent_hour_daytype"), (2, "r", 1, 4, 8, 1, 0, "route_station_hour"),
        (3, "r", 1, 4, 15, 0, 0, "route_station_daytype"), (4, "r", 1, 4, 15, 1, 1, "route_station"), (5, "r", 7, 4, 8, 0, 0, "route_station_seq_hour"),
        (6, "r", None, None, 8, 0, 0, "route_hour"), (7, "r", None, 9, 3, 0, 0, "route"), (8, "z", 1, 4, 22, 0, 0, "hour"), (9, "z", 1, 4, 3, 0, 0, "none"),
    ]
    frame = rows(probes, "id INT, canonical_route_name STRING, station_id BIGINT, station_seq INT, hour INT, is_weekend INT, is_holiday INT, want STRING")
    got = proxy.with_proxy(frame, known).collect()
    assert len(got) == 10 and all(r["historical_proxy_group"] == r["want"] for r in got)
    assert next(r for r in got if r["id"] == 8)["historical_next_station_full_rate"] is None
    assert next(r for r in got if r["id"] == 9)["proxy_remain_source"] == "default_capacity"


def test_demand_and_training(spark, rows, tables):
    built = pipeline.build_features(tables)
    boardings = pipeline.build_boardings(tables, built)
    got = boardings.where("station_id = 228000101 AND route_id = 5000001 AND day_of_week = 3 AND hour = 8").first()
    assert got["expected_boardings_at_stop"] == round((1850 + 1930) / 2 * 0.105 / 8 / 6, 6)
    asked = rows([(228000101, 5000001, "2026-05-20T23:30:00+00:00"), (1, 1, "2026-05-20T23:30:00+00:00")], "station_id BIGINT, route_id BIGINT, s STRING")
    found = demand.with_boardings_at(asked.withColumn("at", F.col("s").cast("timestamp")), boardings).orderBy("station_id").collect()
    assert found[0]["expected_boardings_at_stop"] is None and found[1]["expected_boardings_at_stop"] == got["expected_boardings_at_stop"]


def test_scheduled_row_for_a_route_name(rows, tables):
    routes = rows([(330000042, "5005", "5005", 11, "express")], "route_id BIGINT, route_name STRING, canonical_route_name STRING, route_type_cd INT, route_type_name STRING")
    stops = rows(
        [(330000042, 21, 440000007, "market", None, 126.9101, 37.4102, '{"direction":"DOWN"}')],
        "route_id BIGINT, station_seq INT, station_id BIGINT, station_name STRING, mobile_no STRING, x DOUBLE, y DOUBLE, raw_json STRING",
    )
    from kerbline.operators import schedule
    from kerbline.sources.schemas import HEADWAY_FIELDS, TIMETABLE_FIELDS

    info = {"routeId": "330000042", "weUpFirstTime": "04:40", "weUpLastTime": "22:30", "weDownFirstTime": "06:20", "weDownLastTime": "23:50", "wePeekAlloc": "18", "weNPeekAlloc": "31"}
    wide = rows([tuple(info.get(f) for f in ["routeId"] + TIMETABLE_FIELDS + HEADWAY_FIELDS)], ", ".join(f"{f} STRING" for f in ["routeId"] + TIMETABLE_FIELDS + HEADWAY_FIELDS))
    asked = rows([(1, 440000007, None, "5005")], "request_id BIGINT, requested_station_id BIGINT, asked_route_id BIGINT, asked_route_name STRING")
    requests = live.route_requests(asked, routes).withColumn("at", F.lit("2026-05-19T22:30:00+00:00").cast("timestamp"))
    history = shots(rows, [(1, "2026-05-20T23:05:00+00:00", 1, 10, "A", 100, 10, 2, 3, 11)]).limit(0)
    built = pipeline.build_features({**tables, "snapshots": history}).withColumns({"has_next_station": F.lit(1), "y": F.lit(0)})
    known = proxy.proxy_statistics(built, "y", require_next_station=True)
    got = live.scheduled_rows(requests, schedule.timetable(wide), tables["holidays"], routes, stops, known, history).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["route_id"], r["schedule_direction"], r["schedule_first_time"], r["schedule_proxy_time_basis"], r["schedule_allocation_minutes"]) == (330000042, "down", "06:20", "requested_time", 18)
    assert (r["station_seq"], r["historical_proxy_group"], r["remain_seat_cnt"], r["collected_at_kst"]) == (21, "none", 45, "2026-05-20T07:30:00+09:00")


def test_stops_outside_the_given_bounds_are_an_error(rows):
    data = [(1, 0, 3, 1, "a"), (2, 60, 17, 1, "a")]
    frame = rows(data, "snapshot_id BIGINT, t BIGINT, station_seq INT, veh_id BIGINT, plate_no STRING").withColumns({"route_id": F.lit(1), **{c: F.lit(0) for c in ("is_no_seat", "is_low_seat_2", "is_low_seat_5")}})
    found = labels.label_table(frame, micros=F.col("t") * 1_000_000, seq_bounds=(0, 20)).where("snapshot_id = 1").first()
    assert found["has_next_station"] == 1
    with pytest.raises(Exception, match="outside 0 to 15"):
        labels.label_table(frame, micros=F.col("t") * 1_000_000, seq_bounds=(0, 15)).collect()


def test_label_tasks_hold_a_bounded_number_of_rows(rows, monkeypatch):
    frame = future_rows(rows, [(i, i % 7, i % 40, f"P{i % 40}", i * 37 % 9000, i % 20, i % 4) for i in range(2000)])
    few = labels.label_table(frame, micros=F.col("sec") * 1_000_000)
    monkeypatch.setattr(labels, "TASK_ROWS", 100)
    many = labels.label_table(frame, micros=F.col("sec") * 1_000_000)
    assert many.rdd.getNumPartitions() >= 20 > few.rdd.getNumPartitions()
    assert sorted(many.collect()) == sorted(few.collect())
