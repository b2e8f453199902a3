"""SQL names for the scalar functions: plain SQL functions, which Catalyst inlines."""

from pyspark.sql import SparkSession

from kerbline import constants as C
from kerbline.functions.seats import grid_constants

_SCALE, _POLE, _CONE, _LON0 = (f"{v!r}D" for v in grid_constants())
_RADIUS = f"{_SCALE} / power(tan(pi() / 4 + radians(lat) / 2), {_CONE})"
_TURN = f"(radians(lon) - {_LON0})"
_ANGLE = f"{_CONE} * ({_TURN} - CASE WHEN {_TURN} > pi() THEN 2 * pi() WHEN {_TURN} < -pi() THEN -2 * pi() ELSE 0D END)"
_DEFINITIONS = {
    "canonical_route(name STRING) RETURNS STRING": r"translate(regexp_replace(upper(coalesce(name, '')), '[번\\s()\\[\\]]', ''), '－–—', '---')",
    "time_period(hour INT) RETURNS STRING": """CASE WHEN hour BETWEEN 7 AND 9 THEN 'morning_peak' WHEN hour BETWEEN 17 AND 19 THEN 'evening_peak'
        WHEN hour BETWEEN 5 AND 6 THEN 'early_morning' WHEN hour BETWEEN 10 AND 16 THEN 'daytime'
        WHEN hour BETWEEN 20 AND 23 THEN 'night' ELSE 'late_night' END""",
    "seat_scarcity(remain INT, capacity INT) RETURNS INT": f"""CASE WHEN remain IS NULL THEN NULL WHEN remain <= 0 THEN 100
        WHEN remain >= coalesce(if(capacity > 0, capacity, NULL), {C.DEFAULT_SEATS}) THEN 0
        ELSE CAST(bround(100 * (1 - power(log1p(remain) / log1p(coalesce(if(capacity > 0, capacity, NULL), {C.DEFAULT_SEATS})), {C.SCARCITY_GAMMA}D)), 0) AS INT) END""",
    "weather_text(rain DOUBLE, cloud DOUBLE) RETURNS STRING": """CASE WHEN rain > 0 THEN 'rain' WHEN cloud >= 8 THEN 'cloudy'
        WHEN cloud >= 3 THEN 'partly_cloudy' ELSE 'clear' END""",
    "route_segment(seq INT, max_seq INT) RETURNS STRING": """CASE WHEN coalesce(seq, 0) <= 0 OR coalesce(max_seq, 0) <= 0 THEN 'unknown'
        WHEN seq / max_seq <= 0.25 THEN 'origin_0_25' WHEN seq / max_seq <= 0.5 THEN 'early_mid_25_50'
        WHEN seq / max_seq <= 0.75 THEN 'late_mid_50_75' ELSE 'terminal_75_100' END""",
    "risk_level(p DOUBLE, threshold DOUBLE) RETURNS STRING": """CASE WHEN p >= threshold THEN 'high' WHEN p >= greatest(0.7D, threshold - 0.2D) THEN 'watch'
        WHEN p >= 0.4D THEN 'medium' ELSE 'low' END""",
    "forecast_grid(lon DOUBLE, lat DOUBLE) RETURNS STRUCT<nx: INT, ny: INT>": f"""named_struct('nx', CAST({_RADIUS} * sin({_ANGLE}) + {C.GRID_OFFSET[0]} + 0.5D AS INT),
        'ny', CAST({_POLE} - {_RADIUS} * cos({_ANGLE}) + {C.GRID_OFFSET[1]} + 0.5D AS INT))""",
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions; returns their names."""
    names = []
    for signature, body in _DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(")[0])
    return names
