"""Seats, crowding, weather text and forecast grid as column expressions."""

import math

from pyspark.sql import Column, functions as F

from kerbline import constants as C


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), key.cast("int"))


def default_capacity(route_type: Column) -> Column:
    return F.when(route_type.isin(*C.SEATED_ROUTE_TYPES), F.lit(C.DEFAULT_SEATS))


def estimate_capacity(route_type: Column, observed: Column | None = None) -> Column:
    """Observed seats when positive, else the default of the route type, else null."""
    if observed is None:
        return default_capacity(route_type)
    return F.coalesce(F.when(observed > 0, observed), default_capacity(route_type))


def batch_capacity(route_type: Column, observed: Column) -> Column:
    """Larger of observed and default (``greatest`` skips nulls)."""
    return F.greatest(F.when(observed > 0, observed), default_capacity(route_type))


def scarcity(remain: Column, capacity: Column | None = None, gamma: float = C.SCARCITY_GAMMA) -> Column:
    """0 (empty vehicle) to 100 (no seat): ``100 * (1 - (ln(r+1)/ln(cap+1))^gamma)`` rounded half-even."""
    cap = F.lit(C.DEFAULT_SEATS) if capacity is None else F.coalesce(F.when(capacity > 0, capacity), F.lit(C.DEFAULT_SEATS))
    left = F.greatest(remain, F.lit(0))
    score = 100 * (1 - F.pow(F.log1p(left) / F.log1p(cap), F.lit(gamma)))
    bounded = F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))
    return (
        F.when(remain.isNull(), None)
        .when(left == 0, 100)
        .when(left >= cap, 0)
        .otherwise(F.bround(bounded, 0).cast("int"))
    )


def seat_flags(remain: Column) -> dict[str, Column]:
    def at_most(n):
        return F.coalesce(remain.between(0, n), F.lit(False)).cast("int")

    return {"is_no_seat": at_most(0), "is_low_seat_2": at_most(2), "is_low_seat_5": at_most(5)}


def crowded_label(code: Column) -> Column:
    return _lookup(C.CROWDING_LABELS, code)


def crowding_from_seats(remain: Column) -> Column:
    """Crowding code as the sample city assigns it: no seat 4, up to 5 seats 3, up to 12 seats 2, else 1."""
    return F.when(remain <= 0, 4).when(remain <= 5, 3).when(remain <= 12, 2).otherwise(1)


def route_type_code(enum_name: Column) -> Column:
    """Dump enum to code."""
    return F.when(enum_name.isin("EXPRESS_SEAT", "METROPOLITAN"), 11)


def route_type_label(enum_name: Column) -> Column:
    """Dump enum to name; METROPOLITAN carries the name of code 14 although its code is 11."""
    return (
        F.when(enum_name == "METROPOLITAN", C.ROUTE_TYPE_LABELS[14])
        .when(enum_name == "EXPRESS_SEAT", C.ROUTE_TYPE_LABELS[11])
        .otherwise("unknown")
    )


def weather_text(rain: Column, cloud: Column) -> Column:
    return F.when(rain > 0, "rain").when(cloud >= 8, "cloudy").when(cloud >= 3, "partly_cloudy").otherwise("clear")


def grid_constants() -> tuple[float, float, float, float]:
    """Scale, distance of the pole, cone and longitude (radians) of the Korean forecast grid's projection."""
    phi1, phi2 = (math.radians(p) for p in C.GRID_PARALLELS)
    lon0, lat0 = (math.radians(v) for v in C.GRID_ORIGIN)

    def half_angle(phi):
        return math.tan(math.pi / 4 + phi / 2)

    cone = math.log(math.cos(phi1) / math.cos(phi2)) / math.log(half_angle(phi2) / half_angle(phi1))
    scale = C.GRID_EARTH_RADIUS_KM / C.GRID_STEP_KM * half_angle(phi1) ** cone * math.cos(phi1) / cone
    return scale, scale / half_angle(lat0) ** cone, cone, lon0


def forecast_grid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS84 degrees to the (nx, ny) cell of the Korean forecast grid; constants fold on the driver."""
    scale, pole, cone, lon0 = grid_constants()
    radius = F.lit(scale) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(cone))
    turn = F.radians(lon) - F.lit(lon0)
    turn = F.when(turn > math.pi, turn - 2 * math.pi).when(turn < -math.pi, turn + 2 * math.pi).otherwise(turn)
    angle = turn * F.lit(cone)
    nx = (radius * F.sin(angle) + C.GRID_OFFSET[0] + 0.5).cast("int")
    ny = (F.lit(pole) - radius * F.cos(angle) + C.GRID_OFFSET[1] + 0.5).cast("int")
    return nx, ny
