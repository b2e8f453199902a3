"""Streams give what the batch gives, whatever the batch borders and replays."""

import json
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from kerbline.operators import labels
from kerbline.plans import pipeline
from kerbline.sources.upsert import append_batch, read_latest
from kerbline.streaming import ingest, stateful
from tests import sample_city


def land(city, folder, only=None):
    """Write the city's snapshots as landed JSON lines, one file per poll; every row twice."""
    rows = city["snapshots"].orderBy("snapshot_id").collect()
    folder.mkdir(exist_ok=True)
    polls = {}
    for r in rows:
        polls.setdefault(str(r["collected_at"]), []).append(r)
    for i, (at, shots) in enumerate(sorted(polls.items())):
        if only is not None and i not in only:
            continue
        lines = [
            json.dumps(
                {
                    "collected_at": at.replace(" ", "T") + "+00:00", "routeId": str(r["route_id"]), "vehId": str(r["veh_id"]), "plateNo": r["plate_no"],
                    "stationId": str(r["station_id"]), "stationSeq": str(r["station_seq"]), "remainSeatCnt": str(r["remain_seat_cnt"]),
                    "crowded": str(r["crowded"]), "routeTypeCd": "11", "lowPlate": "0", "stateCd": "1", "taglessCd": "0",
                }
            )
            for r in shots
        ]
        (folder / f"poll{i}.json").write_text("\n".join(lines + lines) + "\n")


def test_ingest_drops_replays(spark, tmp_path):
    city = sample_city.tables(spark)
    land(city, tmp_path / "in")
    stream = ingest.read_landing(spark, str(tmp_path / "in"), 1)
    for _ in range(2):  # The second start finds nothing new.
        query = ingest.append_stream(stream, str(tmp_path / "log"), str(tmp_path / "cp"))
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "log"))
    # Rows that come hours after later ones, and again, are kept once.
    late = [json.dumps({"collected_at": f"2026-05-1{d}T01:00:00+00:00", "routeId": "1", "vehId": v}) for d in (8, 9) for v in ("7", None, "7")]
    (tmp_path / "in" / "late.json").write_text("\n".join(late) + "\n")
    ingest.append_stream(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.where("collected_at < '2026-05-20'").count() == 4
    got = log.where("collected_at >= '2026-05-20'")
    assert got.count() == 128 and got.agg(F.sum("remain_seat_cnt")).first() == city["snapshots"].agg(F.sum("remain_seat_cnt")).first()


def test_bucket_counts_match_batch(spark, tmp_path):
    city = sample_city.tables(spark)
    land(city, tmp_path / "in")
    counted = ingest.bucket_counts(ingest.read_landing(spark, str(tmp_path / "in"), 1))
    query = counted.writeStream.foreachBatch(lambda rows, i: append_batch(rows, str(tmp_path / "out"), i)).outputMode("update")
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r["route_id"], str(r["bucket"])): r["rows"] for r in read_latest(spark, str(tmp_path / "out"), ["route_id", "bucket"]).collect()}
    assert sum(got.values()) == 256 and list(got.values()).count(10) == 24


def test_feature_and_label_streams_match_batch(spark, tmp_path):
    city = sample_city.tables(spark)
    land(city, tmp_path / "in", only=(0, 2))
    base = str(tmp_path)

    def run():
        log = spark.createDataFrame([], "route_id BIGINT, plate_no STRING, remain_seat_cnt INT")
        landed = ingest.read_landing(spark, f"{base}/in", 1)
        ingest.feature_stream(landed, lambda: {**city, "log": log}, f"{base}/features", f"{base}/cp1").awaitTermination(300)
        built = ingest.read_feature_batches(spark, f"{base}/features")
        ingest.label_stream(built, f"{base}/features", f"{base}/labels", f"{base}/cp2").awaitTermination(300)

    run()
    land(city, tmp_path / "in", only=(3,))
    run()
    features = read_latest(spark, f"{base}/features", ["snapshot_id"])
    batch = pipeline.build_features({**city, "snapshots": city["snapshots"].where("collected_at <> '2026-05-20T23:10:00Z'")})
    columns = [c for c in batch.columns if c != "snapshot_id"]
    assert features.count() == 88
    assert features.select(columns).exceptAll(batch.select(columns)).count() == 0
    stored = read_latest(spark, f"{base}/labels", ["snapshot_id"])
    whole = labels.label_table(features, micros=F.unix_micros("collected_at"))
    assert stored.count() == 88 and stored.select(whole.columns).exceptAll(whole).count() == 0
    final = ingest.mature(stored, features, "2026-05-21T10:00:00Z")
    assert final.count() == 80


def test_late_rows_change_earlier_labels(rows):
    data = [(1, 0, 1, 3), (2, 1200, 2, 0), (3, 90_000, 3, 0)]
    frame = rows(data, "snapshot_id BIGINT, sec BIGINT, station_seq INT, remain INT").withColumns(
        {
            "collected_at": F.timestamp_seconds("sec"), "service_date": F.to_date(F.timestamp_seconds("sec")), "route_id": F.lit(1), "veh_id": F.lit(None).cast("bigint"),
            "plate_no": F.lit(None).cast("string"), "is_no_seat": (F.col("remain") == 0).cast("int"), "is_low_seat_2": F.lit(0), "is_low_seat_5": F.lit(0),
        }
    )
    late = frame.where("snapshot_id = 2")
    recent = frame.where(ingest.look_back(late, 1800))
    got = {r["snapshot_id"]: r["target_no_seat_next_station"] for r in ingest.relabel(recent, late).collect()}
    assert got == {1: 1, 2: 0}  # row 3 lies out of reach and isn't read


def landed(path, shots):
    """One landing file of (route, vehicle, plate, second of a day, stop, seats)."""
    lines = [
        json.dumps({"collected_at": f"2026-05-20T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}+00:00", "routeId": str(r), "vehId": v, "plateNo": p, "stationId": "9", "stationSeq": str(q), "remainSeatCnt": str(n)})
        for r, v, p, s, q, n in shots
    ]
    path.write_text("\n".join(lines) + "\n")


def day_of_shots(seed=3):
    """Rows of four vehicles, one of them unknown, over five hours."""
    pick = random.Random(seed)
    rows = set()
    for v in ("1", "2", "3", None):
        for s in range(0, 18_000, 240):
            if pick.random() < 0.8:
                rows.add((1, v, f"P{v}" if v else None, s + pick.randrange(200), pick.randrange(1, 9), pick.choice([0, 0, 1, 2, 3, 9])))
    return sorted(rows, key=lambda r: r[3])


def shuffled_files(folder, rows, seed, late_share=0.1):
    """Files in time order but for some rows that come much later or earlier files again."""
    pick = random.Random(seed)
    folder.mkdir()
    files = [[] for _ in range(6)]
    for i, row in enumerate(rows):
        at = i * 5 // len(rows)
        files[pick.randrange(at, 6) if pick.random() < late_share else at].append(row)
        if pick.random() < 0.1:
            files[pick.randrange(at, 6)].append(row)
    for i, shots in enumerate(files):
        landed(folder / f"f{i:02d}.json", shots)
        os.utime(folder / f"f{i:02d}.json", (1_700_000_000 + i, 1_700_000_000 + i))


def test_ingest_state_is_bounded_and_counts_equal_batch(spark, tmp_path):
    rows = day_of_shots()
    shuffled_files(tmp_path / "in", rows, 5, 0.3)
    stream = ingest.read_landing(spark, str(tmp_path / "in"), 1)
    log, counts, cp = (str(tmp_path / n) for n in ("log", "counts", "cp"))
    held = []
    for _ in range(2):
        query = stateful.ingest_stream(stream, log, counts, cp, delay="10 minutes")
        query.awaitTermination(300)
        held += [max(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    got = spark.read.parquet(log)
    assert got.count() == len(rows) == got.select("collected_at", "veh_id", "station_seq", "remain_seat_cnt").distinct().count()
    assert held and max(held) < len(rows) / 2, "keys leave the state"
    # One row hours ahead closes all windows; it lies in an open one itself.
    landed(tmp_path / "in" / "z.json", [(1, "8", None, 80_000, 1, 1), *rows[:3]])
    for _ in range(2):
        stateful.ingest_stream(stream, log, counts, cp, delay="10 minutes").awaitTermination(300)
    total = {str(r["bucket"])[11:16]: r["rows"] for r in stateful.read_counts(spark.read.parquet(counts)).collect()}
    want = Counter(f"{r[3] // 3600:02d}:{r[3] // 600 % 6}0" for r in rows)
    assert total == dict(want) and spark.read.parquet(log).count() == len(rows) + 1


def feature_files(spark, folder, rows, seed):
    """The rows' features in batches, as the feature stream leaves them, some rows late."""
    pick = random.Random(seed)
    parts = [[] for _ in range(5)]
    for i, (r, v, p, s, q, n) in enumerate(rows):
        at = i * 4 // len(rows)
        parts[pick.randrange(at, 5) if pick.random() < 0.15 else at].append((f"id{i}", r, v and int(v), p, s, q, int(n == 0), int(n <= 2), int(n <= 5)))
    schema = "snapshot_id STRING, route_id BIGINT, veh_id BIGINT, plate_no STRING, sec BIGINT, station_seq INT, is_no_seat INT, is_low_seat_2 INT, is_low_seat_5 INT"
    out = None
    for k, part in enumerate(parts):
        frame = spark.createDataFrame(part, schema).withColumn("collected_at", F.timestamp_seconds(F.lit(1_779_235_200) + F.col("sec")))
        yield k, frame.withColumn("service_date", F.to_date("collected_at"))


def test_final_labels_equal_batch_with_late_rows(spark, tmp_path):
    rows = [r for r in day_of_shots(9) if r[3] < 11_000]
    features, out, cp = (str(tmp_path / n) for n in ("features", "labels", "cp"))
    held = []
    for k, frame in feature_files(spark, features, rows, 2):
        append_batch(frame.coalesce(1), features, k, ["service_date"])
        built = ingest.read_feature_batches(spark, features)
        query = stateful.final_label_stream(built, features, out, cp, delay="10 minutes")
        query.awaitTermination(300)
        held += [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    whole = labels.label_table(read_latest(spark, features, ["snapshot_id"]), micros=F.unix_micros("collected_at"))
    want = {r["snapshot_id"]: r for r in whole.collect()}
    got = {r["snapshot_id"]: r for r in read_latest(spark, out, ["snapshot_id"]).select(whole.columns).collect()}
    last = max(r[3] for r in rows) - 600
    final = {f"id{i}" for i, r in enumerate(rows) if r[3] + 1800 <= last}
    assert final <= set(got) and len(final) > 60
    assert {i: got[i] for i in final} == {i: want[i] for i in final}
    assert held[-1] < 20, "slices that are done hold no state"


def test_features_equal_batch_in_any_order(spark, tmp_path):
    """Context after its snapshots, and a vehicle that shows more free seats later, change rows already built."""
    city = sample_city.tables(spark)
    polls = [tmp_path / "all"]
    land(city, polls[0])
    files = sorted(polls[0].iterdir())
    (tmp_path / "in").mkdir()
    more = [(5000001, "9", "70-101", 3600 * 23 + 900, 3, 44)]  # the plate of earlier rows of this route
    context = str(tmp_path / "weather")
    rows = city["weather"].orderBy("observed_at").collect()

    def run():
        known = {**city, "weather": spark.read.parquet(context)}
        landed_rows = ingest.read_landing(spark, str(tmp_path / "in"), 1)
        changes = ingest.context_changes(spark.readStream.schema(city["weather"].schema).parquet(context), "observed_at")
        ingest.feature_stream(landed_rows, lambda: {k: v for k, v in known.items() if k != "log"}, str(tmp_path / "features"), str(tmp_path / "cp"), changes=changes).awaitTermination(300)

    spark.createDataFrame(rows[2:], city["weather"].schema).write.mode("append").parquet(context)
    for name in (files[1], files[0]):
        (tmp_path / "in" / name.name).write_text(name.read_text())
    run()
    spark.createDataFrame(rows[:2], city["weather"].schema).write.mode("append").parquet(context)
    landed(tmp_path / "in" / "more.json", more)
    run()
    got = read_latest(spark, str(tmp_path / "features"), ["snapshot_id"])
    landed_all = ingest.read_landing(spark, str(tmp_path / "in"), 1000)
    all_rows = spark.read.schema(f"collected_at STRING, {ingest.LOCATION_ITEM}").json(str(tmp_path / "in"))
    snapshots = ingest.with_snapshot_id(ingest.location_snapshots(all_rows).dropDuplicates(list(ingest.SNAPSHOT_KEY)))
    batch = pipeline.build_features({**city, "snapshots": snapshots})
    assert landed_all.columns and got.count() == batch.count() > 80
    columns = batch.columns
    assert got.select(columns).exceptAll(batch).count() == 0
    assert got.where("plate_no = '70-101' AND estimated_capacity < 44").count() == 0 and got.where("plate_no = '70-101'").count() > 1


def test_live_requests_equal_batch(spark, tmp_path):
    """Live, timetable and none rows as for a whole poll, whatever files the arrivals and positions come in; state ends."""
    from kerbline.sources.schemas import HEADWAY_FIELDS, TIMETABLE_FIELDS

    city = sample_city.tables(spark)
    names = ["routeId"] + TIMETABLE_FIELDS + HEADWAY_FIELDS
    info = {"routeId": "5005001", "upFirstTime": "05:00", "upLastTime": "23:00", "peekAlloc": "20", "nPeekAlloc": "30"}
    tables = {**city, "timetables": spark.createDataFrame([tuple(info.get(n) for n in names)], ", ".join(f"{n} STRING" for n in names))}
    history = pipeline.build_training_set(tables, "target_no_seat_next_station").persist()
    slots = ", ".join(f"predict_time{k} INT, predict_time_sec{k} INT, remain_seat_cnt{k} INT, crowded{k} INT, plate_no{k} STRING, veh_id{k} BIGINT" for k in (1, 2))
    none, head = (None,) * 6, "request_id BIGINT, requested_station_id BIGINT, station_id BIGINT, route_id BIGINT, route_name STRING, route_type_cd INT, sta_order INT, turn_seq INT, flag STRING"
    one = city["snapshots"].orderBy("collected_at", "snapshot_id").first()
    data = [
        (1, 228000103, 228000103, 5000001, "5000", 11, 3, None, None, *(5, 300, None, None, "70-101", None), *(9, 540, 7, 2, "no such", None)),
        (2, 228000103, 228000103, 5005001, "5005", 11, 3, None, None, *none, *none),
        (3, 228000103, 228000103, None, None, None, None, None, None, *none, *none),
        (4, 228000103, 228000103, one["route_id"], "5000", 11, 4, None, None, *(5, 300, None, None, "no such", one["veh_id"]), *(6, None, None, None, one["plate_no"], -5)),
    ]
    arrivals = spark.createDataFrame(data, f"{head}, {slots}").withColumn("collected_at", F.lit("2026-05-20T23:30:00Z").cast("timestamp"))
    later = arrivals.where("request_id = 3").withColumns({"request_id": F.lit(9).cast("bigint"), "collected_at": F.lit("2026-05-26T00:00:00Z").cast("timestamp")})
    positions = city["snapshots"].where("collected_at <= '2026-05-20 23:30:00'")
    far = positions.limit(1).withColumn("collected_at", F.lit("2026-05-26T00:00:00Z").cast("timestamp"))
    for frame, folder in ((arrivals, "arrivals"), (positions, "positions")):
        frame.repartition(3).write.parquet(str(tmp_path / folder))

    def streamed(folder, frame):
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder))

    def run():
        build = lambda asked, seen: pipeline.build_slot_rows(tables, asked, seen, history)
        query = stateful.live_stream(streamed("arrivals", arrivals), streamed("positions", positions), build, str(tmp_path / "out"), str(tmp_path / "cp"), delay="1 day", reach="1 day")
        query.awaitTermination(200)
        return query

    run()
    assert not (tmp_path / "out").exists()  # nothing is final yet
    later.write.mode("append").parquet(str(tmp_path / "arrivals"))
    far.write.mode("append").parquet(str(tmp_path / "positions"))
    left = run().recentProgress[-1]["stateOperators"]
    want = pipeline.build_live_rows(tables, arrivals, positions, history)
    kept = [c for c in want.columns if c in ("request_id", "arrival_slot", "prediction_mode", "feature_source", "veh_id", "plate_no", "station_seq", "station_id", "remain_seat_cnt", "crowded", "estimated_capacity", "historical_proxy_rows")]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.select(*kept).collect())) == sorted(map(str, want.select(*kept).collect()))
    assert {(r["request_id"], r["prediction_mode"]) for r in got.collect()} == {(1, "live_vehicle"), (2, "schedule_prior"), (3, "none"), (4, "live_vehicle")}
    assert got.where("feature_source = 'position_match'").count() >= 2
    assert sum(op["numRowsTotal"] for op in left) <= 8  # of the one arrival and the one position that are still open
