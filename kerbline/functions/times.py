"""Time handling. Instants are UTC; Korean wall time (+09:00, no daylight saving) only appears in derived columns."""

from pyspark.sql import Column, functions as F

from kerbline.constants import DAY_NAMES_KO

KST = "+09:00"
# Rewrites that bring every accepted text to one shape, in order; each step reads the text once.
_KST_SHAPES = (
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})?(\d{2})?$", "$1-$2-$3 $4:$5"),  # compact digits
    (r"^(\d{4}-\d{2}-\d{2})( :)?$", "$1 00:00"),  # a day alone
    (r"([ T]\d{2}):?$", "$1:00"),  # an hour alone
    (r"([ T]\d{2}:\d{2})($|Z|[+-])", "$1:00$2"),  # no seconds
    (r"([ T])24:", "$100:"),  # hour 24, a day is added below
    (r"^([^ T]+[ T][0-9:.]+)$", "$1+09:00"),  # no offset
)
_INSTANT = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:?\d{2}))$"


def parse_instant(col: Column) -> Column:
    """ISO text to an instant; without an offset it is UTC."""
    return F.trim(col.cast("string")).try_cast("timestamp")


def parse_kst(col: Column) -> Column:
    """Dashed, ISO or compact (8, 10, 12 digits) text to an instant; without an offset it is Korean time.

    Hour 24 is read as midnight of the next day; anything else that does not parse is null.
    """
    raw = F.trim(col.cast("string"))
    text = raw
    for pattern, shape in _KST_SHAPES:
        text = F.regexp_replace(text, pattern, shape)
    instant = F.regexp_extract(text, _INSTANT, 1).try_cast("timestamp")
    return instant + F.when(raw.rlike(r"^\d{8}24|[ T]24"), F.expr("INTERVAL '1' DAY")).otherwise(F.expr("INTERVAL '0' DAY"))


def kst_wall(instant: Column) -> Column:
    """The wall clock in Korea, as a timestamp whose UTC fields read as Korean time."""
    return F.from_utc_timestamp(instant, KST)


def iso_utc(instant: Column) -> Column:
    return F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def iso_kst(instant: Column) -> Column:
    return F.concat(F.date_format(kst_wall(instant), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(KST))


def kst_date(col: Column) -> Column:
    """Calendar day in Korea of any text ``parse_kst`` accepts."""
    return F.to_date(kst_wall(parse_kst(col)))


def service_day(col: Column) -> Column:
    """Eight digits or the first ten characters, as a date."""
    text = F.trim(col.cast("string"))
    text = F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))\
        .otherwise(F.substring(text, 1, 10))
    return text.try_cast("date")


def compact_day(col: Column) -> Column:
    """``yyyyMMdd`` or ISO date text to a date."""
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(r"^\d{8}$"), service_day(text)).when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), service_day(text))


def local_datetime_to_utc(col: Column) -> Column:
    """Korean ``datetime(6)`` text to an instant with whole seconds."""
    return F.date_trunc("second", F.to_utc_timestamp(F.trim(col.cast("string")).try_cast("timestamp"), KST))


def day_name(weekday: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES_KO]), weekday.cast("int") + 1)


def ten_minute_bucket(wall: Column) -> Column:
    return F.format_string("%02d:%02d", F.hour(wall), (F.floor(F.minute(wall) / 10) * 10).cast("int"))


def time_period(hour: Column) -> Column:
    return (
        F.when(hour.between(7, 9), "morning_peak")
        .when(hour.between(17, 19), "evening_peak")
        .when(hour.between(5, 6), "early_morning")
        .when(hour.between(10, 16), "daytime")
        .when(hour.between(20, 23), "night")
        .otherwise("late_night")
    )


def is_headway_peak(hour: Column) -> Column:
    """Peak as timetables mean it: 7 to 9 and 17 to 20, both ends included."""
    return hour.between(7, 9) | hour.between(17, 20)


def clock_minutes(col: Column) -> Column:
    """``HH:MM`` to minutes of the day; 0, empty and malformed are null."""
    text = F.trim(col.cast("string"))
    hours = F.split_part(text, F.lit(":"), F.lit(1)).try_cast("int")
    minutes = F.substring(F.split_part(text, F.lit(":"), F.lit(2)), 1, 2).try_cast("int")
    return F.when(text.contains(":"), hours * 60 + minutes)


def minute_of_day(wall: Column) -> Column:
    return F.hour(wall) * 60 + F.minute(wall)


def in_service(minute: Column, first: Column, last: Column) -> Column:
    """Whether a minute lies in the service window; a window that ends before it starts wraps past midnight."""
    wrapped = F.when(first <= last, minute.between(first, last)).when(first > last, (minute >= first) | (minute <= last))
    return F.coalesce(wrapped, F.lit(False))


def next_departure(wall: Column, first: Column) -> Column:
    """Wall time of the next first departure: today, or tomorrow when it has passed."""
    day = F.to_date(wall)
    day = F.when(minute_of_day(wall) > first, F.date_add(day, 1)).otherwise(day)
    return F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + first * 60)


def kst_parts(instant: Column) -> dict[str, Column]:
    """Calendar columns every feature row carries."""
    wall = kst_wall(instant)
    weekday = F.weekday(wall)
    return {
        "collected_at_utc": iso_utc(instant),
        "collected_at_kst": iso_kst(instant),
        "service_date": F.to_date(wall),
        "day_of_week": weekday,
        "day_name_ko": day_name(weekday),
        "is_weekend": (weekday >= 5).cast("int"),
        "hour": F.hour(wall),
        "minute": F.minute(wall),
        "time_bucket_10m": ten_minute_bucket(wall),
        "time_period": time_period(F.hour(wall)),
    }
