"""Chronological train / calibration / test splits, exact at any size."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.operators.ranking import cut_keys, first_rows, time_levels


def train_size(n: Column, test_ratio: float, least: int = 1) -> Column:
    """``int(n * (1 - ratio))`` kept within [least, n - 1]."""
    return F.greatest(F.lit(least), F.least(n - 1, F.floor(n * F.lit(1.0 - test_ratio))))


def chronological_split(rows: DataFrame, micros: Column, row_id: Column, test_ratio: float = 0.2) -> DataFrame:
    """Adds ``split``: the earliest rows are ``train``, the rest ``test``."""
    marked = first_rows(rows, [], time_levels(micros, row_id), lambda n: train_size(n, test_ratio))
    return marked.withColumn("split", F.when(F.col("in_first"), "train").otherwise("test")).drop("in_first")


def chronological_cut(rows: DataFrame, micros: Column, row_id: Column, test_ratio: float = 0.2, least: int = 1) -> dict:
    """The (time, id) of the last training row as plain values, so that filters on it reach the scan."""
    cut = cut_keys(rows, [], time_levels(micros, row_id), lambda n: train_size(n, test_ratio, least)).first()
    if cut is None:
        raise ValueError("a split needs at least two rows")
    return {"micros": cut["cut"][2], "row_id": cut["cut"][4], "rows": cut["group_rows"], "train": cut["wanted_rows"]}


def before_cut(micros: Column, row_id: Column, cut: dict) -> Column:
    return (micros < cut["micros"]) | ((micros == cut["micros"]) & (row_id <= cut["row_id"]))


def three_way_split(
    rows: DataFrame, micros: Column, row_id: Column, test_ratio: float = 0.2, calibration_ratio: float = 0.2
) -> DataFrame:
    """64/16/20 by default: the last part of the training pool becomes ``calibration``."""
    levels = time_levels(micros, row_id)
    pool = first_rows(rows, [], levels, lambda n: train_size(n, test_ratio, 2)).withColumnRenamed("in_first", "in_pool")

    def fit_rows(n):
        return n - F.greatest(F.lit(1), F.floor(n * F.lit(calibration_ratio)))

    fit_cut = cut_keys(pool.where("in_pool"), [], levels, fit_rows).select("cut").scalar()
    fit = F.struct(*[level.alias(f"_k{i}") for i, level in enumerate(levels)]) <= fit_cut
    return pool.withColumn(
        "split", F.when(~F.col("in_pool"), "test").when(fit, "train").otherwise("calibration")
    ).drop("in_pool")


def grouped_split(
    rows: DataFrame, group: str, micros: Column, row_id: Column, test_ratio: float = 0.2
) -> DataFrame:
    """Chronological split inside each group, rows without a group being one; groups with fewer than two rows are ``skipped``."""
    marked = first_rows(rows, [group], time_levels(micros, row_id), lambda n: train_size(n, test_ratio), "group_rows")
    part = F.when(F.col("group_rows") < 2, "skipped").when(F.col("in_first"), "train").otherwise("test")
    return marked.withColumn("split", part).drop("in_first", "group_rows")


def grouped_split_counts(rows: DataFrame, group: str, target: str, test_ratio: float = 0.2) -> DataFrame:
    """Sizes of the per-group split, skipped groups included."""
    n = F.col("total_rows")
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("total_rows"), F.sum(target).alias("_pos"))
    skipped = n < 2
    fit = F.when(skipped, 0).otherwise(train_size(n, test_ratio)).cast("bigint")
    return counts.select(
        group,
        "total_rows",
        fit.alias("train_rows"),
        F.when(skipped, F.lit(0)).otherwise(n - fit).cast("bigint").alias("test_rows"),
        F.bround(F.col("_pos") / n, 6).alias("positive_rate"),
        skipped.cast("int").alias("skipped"),
    )


def earliest_test_rows(test: DataFrame, micros: Column, row_id: Column, most: int | Callable[[Column], Column]) -> DataFrame:
    """The first test rows in time order: so many (an optional cap of the back-test), or what ``most`` makes of their number."""
    levels = time_levels(micros, row_id)
    return first_rows(test, [], levels, most if callable(most) else lambda n: F.least(n, F.lit(most))).where("in_first").drop("in_first")
