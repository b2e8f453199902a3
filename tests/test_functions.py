"""Scalar functions against fixed expectations."""

import pytest
from pyspark.sql import functions as F

from kerbline.functions import scores, seats, sqlnames, text, times


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("remain,score", [(1, 97), (2, 93), (3, 89), (0, 100), (45, 0), (60, 0), (-1, 100)])
def test_scarcity(spark, remain, score):
    assert one(spark, seats.scarcity(F.lit(remain), F.lit(45))) == score


def test_scarcity_steps_shrink(spark):
    values = [one(spark, seats.scarcity(F.lit(n), F.lit(45))) for n in (3, 10, 11)]
    assert values[0] - values[1] > values[1] - values[2]


@pytest.mark.parametrize("kind,observed,seats_", [(11, 39, 39), (11, None, 45), (13, None, None)])
def test_capacity(spark, kind, observed, seats_):
    assert one(spark, seats.estimate_capacity(F.lit(kind), F.lit(observed).cast("int"))) == seats_


@pytest.mark.parametrize("raw,name", [("5001(A)", "5001A"), ("5001-1 (b)", "5001-1B"), ("5000번", "5000"), ("5001–1[a]", "5001-1A"), (None, "")])
def test_canonical_route(spark, raw, name):
    assert one(spark, text.canonical_route(F.lit(raw).cast("string"))) == name


def test_target_route(spark):
    assert one(spark, text.is_target_route(F.lit("5003(B)"))) is True
    assert one(spark, text.is_target_route(F.lit("5002"))) is False
    assert one(spark, text.is_target_route(F.lit("5000"), [F.lit("수원")], "용인")) is False
    assert one(spark, text.is_target_route(F.lit("5000"), [F.lit("")], "용인")) is True


def test_forecast_grid(spark):
    nx, ny = seats.forecast_grid(F.lit(126.9780), F.lit(37.5665))
    assert (one(spark, nx), one(spark, ny)) == (60, 127)
    nx, ny = seats.forecast_grid(F.lit(127.0284667), F.lit(37.49545))
    assert 60 <= one(spark, nx) <= 62 and 124 <= one(spark, ny) <= 126


@pytest.mark.parametrize(
    "raw,kst",
    [
        ("2026-05-21 08:00", "2026-05-21T08:00:00+09:00"),
        ("2026-05-21 08:00:05", "2026-05-21T08:00:05+09:00"),
        ("20260521", "2026-05-21T00:00:00+09:00"),
        ("2026052108", "2026-05-21T08:00:00+09:00"),
        ("202605210805", "2026-05-21T08:05:00+09:00"),
        ("2026-05-20T23:05:00+00:00", "2026-05-21T08:05:00+09:00"),
        ("2026-05-20T23:05:00Z", "2026-05-21T08:05:00+09:00"),
        ("2026-05-21T08:05:00", "2026-05-21T08:05:00+09:00"),
        ("2026-05-21", "2026-05-21T00:00:00+09:00"),
        ("2026-05-21 24:00", "2026-05-22T00:00:00+09:00"),
        ("2026", None),
        ("2026-13-01 00:00", None),
        ("soon", None),
        ("", None),
    ],
)
def test_parse_kst(spark, raw, kst):
    assert one(spark, times.iso_kst(times.parse_kst(F.lit(raw)))) == kst


def test_dates_and_dump_time(spark):
    assert str(one(spark, times.kst_date(F.lit("20260524")))) == "2026-05-24"
    assert one(spark, times.iso_utc(times.local_datetime_to_utc(F.lit("2026-05-13 01:18:43.108223")))) == "2026-05-12T16:18:43+00:00"
    assert str(one(spark, times.compact_day(F.lit("20260401")))) == "2026-04-01"
    assert one(spark, times.compact_day(F.lit("April"))) is None


@pytest.mark.parametrize(
    "raw,strict,loose,comma", [("5", 5, 5, 5), (" 7 ", 7, 7, 7), ("5.7", None, 5, 5), ("1,234", None, None, 1234), ("", None, None, None), ("x", None, None, None)]
)
def test_safe_numbers(spark, raw, strict, loose, comma):
    value = F.lit(raw)
    assert one(spark, text.strict_int(value)) == strict
    assert one(spark, text.loose_int(value)) == loose
    assert one(spark, text.comma_int(value)) == comma


@pytest.mark.parametrize("raw,flag", [("0", 0), ("1", 1), ("Y", 1), ("N", 0), (None, 1), ("", 1)])
def test_zero_is_not_missing(spark, raw, flag):
    assert one(spark, text.flag_or(F.lit(raw).cast("string"), 1)) == flag


@pytest.mark.parametrize("raw,minutes", [("06:50", 410), ("00:10", 10), ("0", None), ("", None), ("a:b", None)])
def test_clock_minutes(spark, raw, minutes):
    assert one(spark, times.clock_minutes(F.lit(raw))) == minutes


@pytest.mark.parametrize(
    "minute,first,last,open_", [(480, 410, 10, True), (5, 410, 10, True), (100, 410, 10, False), (480, 300, 1380, True), (200, 300, 1380, False), (1, None, 5, False)]
)
def test_service_window_wraps(spark, minute, first, last, open_):
    assert one(spark, times.in_service(F.lit(minute), F.lit(first).cast("int"), F.lit(last))) is open_


def test_next_departure_is_tomorrow_when_passed(spark):
    wall = F.timestamp_seconds(F.lit(1779264000))  # 2026-05-20 08:00
    assert str(one(spark, times.next_departure(wall, F.lit(300)).cast("string"))) == "2026-05-21 05:00:00"
    assert str(one(spark, times.next_departure(wall, F.lit(500)).cast("string"))) == "2026-05-20 08:20:00"


def test_two_peaks_differ(spark):
    assert one(spark, times.is_headway_peak(F.lit(20))) is True
    assert one(spark, times.time_period(F.lit(20))) == "night"


def test_scores(spark):
    assert abs(one(spark, scores.sigmoid(scores.logit(F.lit(0.3)))) - 0.3) < 1e-9
    assert one(spark, scores.risk_level(F.lit(0.72), 0.9)) == "watch"
    assert one(spark, scores.segment(F.lit(0), F.lit(10))) == "unknown"
    assert one(spark, scores.segment(F.lit(10), F.lit(10))) == "terminal_75_100"
    assert one(spark, scores.proxy_confidence(F.lit("hour"), F.lit(100))) == "very_low"


def test_sql_names_agree_with_columns(spark):
    sqlnames.register(spark)
    assert spark.sql("SELECT seat_scarcity(2, 45)").first()[0] == 93
    assert spark.sql("SELECT canonical_route('5001-1 (b)번')").first()[0] == "5001-1B"
    assert text.camel_case("historical_proxy_group") == "historicalProxyGroup"


def test_sql_name_of_the_forecast_grid(spark):
    sqlnames.register(spark)
    places = spark.createDataFrame([(126.0 + i / 3, 33.0 + i / 4) for i in range(20)] + [(-179.0, 36.0), (None, 36.0)], "lon DOUBLE, lat DOUBLE")
    nx, ny = seats.forecast_grid(F.col("lon"), F.col("lat"))
    got = places.select(nx.alias("nx"), ny.alias("ny"), F.expr("forecast_grid(lon, lat)").alias("g")).collect()
    assert [(r["nx"], r["ny"]) for r in got] == [(r["g"]["nx"], r["g"]["ny"]) for r in got]
