"""Probability, risk-level and encoding expressions."""

import math

from pyspark.sql import Column, functions as F


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    turn = value * F.lit(2 * math.pi / period)
    return F.sin(turn), F.cos(turn)


def logit(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(clipped / (1 - clipped))


def sigmoid(z: Column) -> Column:
    bounded = F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0))
    return 1 / (1 + F.exp(-bounded))


def linear_probability(weights: dict[str, float], intercept: float) -> Column:
    """Logistic score of named columns."""
    z = F.lit(float(intercept))
    for name, weight in weights.items():
        z = z + F.col(name) * F.lit(float(weight))
    return sigmoid(z)


def segment(seq: Column, max_seq: Column) -> Column:
    """Quarter of the route a stop lies in."""
    progress = seq / max_seq
    return (
        F.when(F.coalesce(seq, F.lit(0)) <= 0, "unknown")
        .when(F.coalesce(max_seq, F.lit(0)) <= 0, "unknown")
        .when(progress <= 0.25, "origin_0_25")
        .when(progress <= 0.50, "early_mid_25_50")
        .when(progress <= 0.75, "late_mid_50_75")
        .otherwise("terminal_75_100")
    )


def risk_level(p: Column, threshold: float) -> Column:
    return (
        F.when(p >= threshold, "high")
        .when(p >= max(0.7, threshold - 0.2), "watch")
        .when(p >= 0.4, "medium")
        .otherwise("low")
    )


def proxy_confidence(level: Column, rows: Column) -> Column:
    near = level.isin("route_station_hour_daytype", "route_station_adjacent_hour_daytype", "route_station_daytype")
    return (
        F.when((level == "route_station_hour_daytype") & (rows >= 20), "high")
        .when(near & (rows >= 10), "medium")
        .when(~level.isin("none", "hour") & (rows >= 5), "low")
        .otherwise("very_low")
    )


def ratio(top: Column, bottom: Column, default: float = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(default))
