"""Landing payloads, CSV, dumps, upserts and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from kerbline.sources import context, dimensions, dump, schemas, sinks, snapshots, upsert



def dumped(tables, end="\n"):
    """A dump of ``{table: [rows of SQL texts by column]}``; columns a row leaves out are NULL."""
    parts = ["-- a dump"]
    for name, inserted in tables.items():
        columns = [c.strip() for c in schemas.DUMP_TABLES[name].split(",")]
        parts.append(f"CREATE TABLE `{name}` (" + end + f",{end}".join(f"  `{c}` text" for c in columns) + f"{end});")
        for together in inserted:
            tuples = ",".join("(" + ",".join(row.get(c, "NULL") for c in columns) + ")" for row in together)
            parts.append(f"INSERT INTO `{name}` VALUES {tuples};")
    return end.join(parts) + end


def sighting(number, **more):
    base = {"id": f"{number}", "collected_at": "'2031-02-03 04:05:06.250000'", "external_route_id": "'610'", "external_station_id": "'77'", "external_vehicle_id": "'9001'", "plate_no": "'QX-1'", "station_sequence": "4", "remaining_seat_count": "12", "crowded_code": "2"}
    return {**base, **more}


LONG = "x" * 1_000_000
TABLES = {
    "bus_route": [
        [
            {"id": "5", "external_route_id": "'610'", "route_name": "'5000'", "route_type": "'METROPOLITAN'", "default_capacity": "39", "end_station_name": r"'it''s; (far), \'quoted\''", "active": "_binary '1'", "start_station_name": "'NULL'"},
            {"id": "6", "external_route_id": "'611'", "route_name": "'77'", "route_type": "'UNKNOWN'"},
        ]
    ],
    "station": [[{"id": "31", "external_station_id": "'77'", "station_name": f"'{LONG}'", "longitude": "126.5", "latitude": "37.25"}]],
    "route_station": [[{"id": "1", "route_id": "5", "station_id": "31", "station_sequence": "'04'", "direction": "'DOWN'"}], [{"id": "2", "route_id": "5", "station_id": "31", "station_sequence": "4", "direction": "'UP'"}]],
    "bus_snapshot": [
        [sighting(1, remaining_seat_count="-1"), sighting(2, external_route_id="'611'"), sighting(3, collected_at="NULL")],
        [sighting(4, collected_at="'2031-02-03 04:05:06.900000'"), sighting(5, plate_no="'QX-2'", remaining_seat_count="0")],
    ],
}
KNOWN = "collected_at TIMESTAMP, route_id BIGINT, veh_id BIGINT, station_id BIGINT, station_seq INT, plate_no STRING"


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_dump_import(spark, tmp_path, end):
    path = tmp_path / "dump.sql"
    path.write_bytes(dumped(TABLES, end).encode())
    got = dump.import_dump(spark, str(path), spark.createDataFrame([], KNOWN))
    route = got["routes"].collect()
    assert [(r["route_id"], r["end_station_name"], r["start_station_name"], r["route_type_cd"]) for r in route] == [(610, "it's; (far), 'quoted'", "NULL", 11)]
    # '04' and 4 are one place in the route; the later row wins.
    stop = got["route_stations"].collect()
    assert [(r["station_seq"], len(r["station_name"]), r["x"], json.loads(r["raw_json"])["direction"]) for r in stop] == [(4, len(LONG), 126.5, "UP")]
    # Row 4 has the key of row 1 once times are whole seconds; row 3 has no time.
    assert got["summary"].first().asDict() == {"seen": 5, "imported": 2, "skipped_existing": 1, "skipped_non_target": 1, "rejected": 1, "minus_one_as_zero": 1}
    new = {r["plate_no"]: r for r in got["snapshots"].where("outcome = 'imported'").collect()}
    assert [(new[p]["remain_seat_cnt"], new[p]["route_id"], str(new[p]["collected_at"])) for p in ("QX-1", "QX-2")] == [(0, 610, "2031-02-02 19:05:06")] * 2
    raw = [json.loads(new[p]["raw_json"]) for p in ("QX-1", "QX-2")]
    assert [(r["original_remaining_seat_count"], r["normalized_from_minus_one"]) for r in raw] == [(-1, True), (0, False)]
    again = dump.import_dump(spark, str(path), got["snapshots"].where("outcome = 'imported'"))
    assert again["summary"].first()["imported"] == 0
    every = dump.import_dump(spark, str(path), spark.createDataFrame([], KNOWN), target_only=False, minus_one_as_zero=False)
    assert every["summary"].first()["imported"] == 3 and every["summary"].first()["minus_one_as_zero"] == 0


def test_one_statement_is_read_in_many_blocks(spark, tmp_path):
    """Rows, quotes, parentheses and statement borders fall on any block border; a field is longer than several blocks."""
    notes = ["plain", "it's (a), (b);", "\\\\ back\\slash\\", "", None, "(((", "');\nINSERT INTO `ride` VALUES (9,'no", "x(" * 400, "'" * 7, "),("]
    rows = [(i, notes[i % len(notes)]) for i in range(300)]

    def quoted(note):
        return "NULL" if note is None else "'" + note.replace("\\", "\\\\").replace("'", "''" if len(note) % 2 else "\\'") + "'"

    one = "INSERT INTO `ride` (`id`, `note`) VALUES " + ",".join(f"({i},{quoted(n)})" for i, n in rows[:250]) + ";\n"
    other = "-- that's (not) a row\nINSERT INTO `other` VALUES (1,'a(b'),(2,'c');\nSELECT (7);\n"
    rest = "INSERT INTO `ride` VALUES\r\n" + ",\r\n".join(f"({i}, {quoted(n)})" for i, n in rows[250:]) + ";\r\n"
    path = tmp_path / "rides.sql"
    path.write_bytes((one + other + rest).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("331", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        dumped = dump.read_dump(spark, str(path))
        got = dump.dump_table(dumped, "ride", "id, note").orderBy("_order").collect()
        others = sorted(r["note"] for r in dump.dump_table(dumped, "other", "id, note").collect())
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [(int(r["id"]), r["note"]) for r in got] == rows and others == ["a(b", "c"]


def envelopes(spark, payloads, key="busArrivalList"):
    frame = spark.createDataFrame([(i, json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)], "id INT, value STRING")
    return snapshots.read_envelopes(frame, "routeId STRING", key)


def test_envelope_shapes(spark):
    items, rejects = envelopes(
        spark,
        [
            {"response": {"msgHeader": {"resultCode": 0}, "msgBody": {"busArrivalList": [{"routeId": 1}, {"routeId": 2}]}}},
            {"response": {"msgHeader": {"resultCode": "00"}, "msgBody": {"busArrivalList": {"routeId": 3}}}},
            {"response": {"msgHeader": {"resultCode": "4", "resultMessage": "결과가 존재하지 않습니다."}, "msgBody": {}}},
            {"response": {"header": {"resultCode": "00"}, "body": {"items": {"item": [{"routeId": 4}]}}}},
            {"response": {"header": {"resultCode": "00"}, "body": {"items": ""}}},
            {"response": {"header": {"resultCode": "30", "resultMsg": "key"}}},
            {"items": [{"routeId": 5}]},
        ],
    )
    assert sorted((r["id"], r["routeId"]) for r in items.collect()) == [(0, "1"), (0, "2"), (1, "3"), (3, "4"), (6, "5")]
    assert [(r["id"], r["result_code"], r["result_message"]) for r in rejects.collect()] == [(5, "30", "key")]


def write(path, text):
    path.write_text("﻿" + text, encoding="utf-8")
    return str(path)


def test_context_csv(spark, tmp_path):
    weather = write(tmp_path / "w.csv", "stnId,tm,ta,rn,dc10Tca\n119,2026-05-21 07:00,15.8,0,9\n119,2026-05-21 07:00,16.8,,1\n119,bad,1,1,1\n")
    got = context.read_context_csv(spark, "weather", weather).collect()
    assert len(got) == 1 and (got[0]["temperature"], got[0]["weather_text"], got[0]["humidity"]) == (16.8, "clear", 0.0)
    assert got[0]["source"].startswith("csv:") and json.loads(got[0]["raw_json"])["ta"] == "16.8"
    air = write(tmp_path / "a.csv", "stationName,dataTime,pm10Value,khaiGrade\n용인,2026-05-21 24:00,-,2\n")
    got = context.read_context_csv(spark, "air", air).first()
    assert (got["air_station_name"], got["pm10"], got["air_quality_grade"], got["observed_at_kst"]) == ("용인", 0.0, "2", "2026-05-22T00:00:00+09:00")
    traffic = write(tmp_path / "t.csv", "tm,speed,congestionLevel\n202605210700,41.5,3.9\n")
    got = context.read_context_csv(spark, "traffic", traffic).first()
    assert (got["traffic_context_key"], got["avg_speed"], got["congestion_level"]) == ("global", 41.5, 3)
    days = write(tmp_path / "h.csv", "locdate,dateName,isHoliday\n20260524,Day,Y\n20260525,Other,N\n20260526,Third,\n")
    assert {str(r["service_date"]): r["is_holiday"] for r in context.read_context_csv(spark, "holiday", days).collect()} == {"2026-05-24": 1, "2026-05-25": 0, "2026-05-26": 1}
    events = write(tmp_path / "e.csv", "event_date,event_count\n2026-05-21,0\n2026-05-22,\n")
    assert {str(r["service_date"]): r["event_count"] for r in context.read_context_csv(spark, "event", events).collect()} == {"2026-05-21": 0, "2026-05-22": 1}
    with pytest.raises(ValueError):
        context.read_context_csv(spark, "tides", events)


def test_demand_csv(spark, tmp_path):
    path = write(tmp_path / "d.csv", '일자,정류소아이디,정류소명,승차인원합계\n20260520,100,a,"1,200"\n20260520,100,b,"1,300"\n,101,c,5\n')
    got = context.read_station_demand_csv(spark, path).collect()
    assert len(got) == 1 and (str(got[0]["service_date"]), got[0]["station_id"], got[0]["boarding_total"], got[0]["station_name"]) == ("2026-05-20", 100, 1300, "b")


def test_event_spans(spark, rows):
    spans = rows([("20260501", "20260503"), ("20260503", None), ("20260420", "20260610")], "s STRING, e STRING")
    from kerbline.functions import times

    got = context.event_days(spans, times.compact_day(F.col("s")), times.compact_day(F.col("e")), "2026-05-01", "2026-05-04")
    assert {str(r["service_date"])[-2:]: r["event_count"] for r in got.collect()} == {"01": 2, "02": 2, "03": 3, "04": 1}
    assert context.date_range(spark, "2026-05-01", "2026-05-04").count() == 4


def test_upsert_and_batches(spark, rows, tmp_path):
    old = rows([(1, "a", 0), (2, "b", 0), (None, "n", 0)], "k INT, v STRING, o INT")
    new = rows([(2, "x", 1), (2, "y", 2), (None, "m", 1), (3, "z", 1)], "k INT, v STRING, o INT")
    got = upsert.upsert(old, new, ["k"], "o")
    want = {1: "a", 2: "y", None: "m", 3: "z"}
    assert {r["k"]: r["v"] for r in got.collect()} == want and got.count() == 4
    assert {r["k"]: r["v"] for r in upsert.upsert(got, new, ["k"], "o").collect()} == want
    path = str(tmp_path / "table")
    upsert.append_batch(old, path, 0)
    for _ in range(2):  # A replayed batch changes nothing.
        upsert.append_batch(upsert.latest_per_key(new, ["k"], ["o"]), path, 1)
    assert {r["k"]: r["v"] for r in upsert.read_latest(spark, path, ["k"]).collect()} == want
    upsert.compact(spark, path, str(tmp_path / "small"), ["k"])
    assert {r["k"]: r["v"] for r in upsert.read_latest(spark, str(tmp_path / "small"), ["k"]).collect()} == want


def test_dimensions(spark, rows):
    fields = [f.split()[0] for f in schemas.ROUTE_ITEM.split(", ")] + ["landed_at"]
    schema = schemas.ROUTE_ITEM + ", landed_at INT"

    def item(**values):
        return tuple(values.get(f) for f in fields)

    found = rows([item(routeId="1", routeName="5000", landed_at=1), item(routeId="1", routeName="5000번", landed_at=2), item(routeId="x", routeName="5005", landed_at=1), item(routeId="2", routeName="77", landed_at=1)], schema)
    detail = rows([item(routeId="1", regionName="용인", routeTypeCd="11", landed_at=1)], schema)
    got = dimensions.landed_target_routes(found, detail)
    route = got["routes"].collect()
    assert len(route) == 1 and (route[0]["route_id"], route[0]["canonical_route_name"], route[0]["region_name"], route[0]["route_type_cd"]) == (1, "5000", "용인", 11)
    assert got["missing"].count() == 7
    stops = rows([("1", "0", "9"), (None, "2", "8"), (None, None, "7")], "stationSeq STRING, staOrder STRING, stationId STRING")
    for name in ("stationName", "mobileNo", "x", "y", "regionName", "centerYn", "turnYn"):
        stops = stops.withColumn(name, F.lit(None).cast("string"))
    got = dimensions.route_stations(stops, F.lit(1), F.lit("5000"))
    assert sorted((r["station_seq"], r["station_id"]) for r in got.collect()) == [(1, 9), (2, 8)]
    assert dimensions.route_ids_for_name(route_frame(rows), "5000 번").count() == 2


def route_frame(rows):
    return rows([(1, "5000"), (2, "5000"), (3, "5005")], "route_id BIGINT, canonical_route_name STRING")


def test_arrival_snapshots(rows):
    names = [f.split()[0] for f in schemas.ARRIVAL_ITEM.split(", ")]
    values = {"stationId": "9", "routeId": "1", "routeName": "5000", "remainSeatCnt1": "7", "plateNo1": "P", "predictTime1": "x", "vehId2": "12"}
    got = snapshots.arrival_snapshots(rows([tuple(values.get(n) for n in names)], schemas.ARRIVAL_ITEM), F.lit("2026-05-21T00:00:00Z")).first()
    assert (got["remain_seat_cnt1"], got["plate_no1"], got["predict_time1"], got["veh_id2"], got["plate_no2"]) == (7, "P", None, 12, None)


def test_sinks(spark, rows, tmp_path):
    frame = rows([(2, "b"), (1, "가")], "route_id INT, v STRING")
    sinks.write_csv(frame, str(tmp_path / "c"), ("route_id",))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("route_id").collect()] == [("1", "가"), ("2", "b")]
    frame.createOrReplaceTempView("sink_rows")
    sinks.export_table(spark, "sink_rows", str(tmp_path / "t"))
    sinks.export_query(spark, "SELECT v FROM sink_rows WHERE route_id = 1", str(tmp_path / "q"))
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).first()["v"] == "가"
    sinks.write_json(frame, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    for _ in range(2):
        sinks.append_metrics(rows([("t", 0.5, [1])], "target STRING, f1 DOUBLE, parts ARRAY<INT>"), str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m"))
    assert got.count() == 2 and json.loads(got.first()["metrics_json"])["parts"] == [1] and "parts" not in got.columns
    snaps = rows([(1, "2026-05-21T00:00:00Z")], "route_id INT, s STRING").select("route_id", F.col("s").cast("timestamp").alias("collected_at"))
    snapshots.append_snapshots(snaps, str(tmp_path / "s"))
    assert (tmp_path / "s" / "ingest_date=2026-05-21").exists()
