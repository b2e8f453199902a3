"""Classification metrics over prediction rows (``actual``, ``probability``, ``t`` micros, ``row_id``, groups).

Everything is counted with map-side-combined aggregates; nothing sorts all rows in one place.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline import constants as C
from kerbline.functions import scores
from kerbline.operators.ranking import cut_keys, key_struct, score_levels, with_group

_SCORE_BUCKETS = 1 << 20


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = scores.ratio(tp, tp + fp), scores.ratio(tp, tp + fn)
    return {
        "accuracy": F.bround(scores.ratio(tp + tn, tp + fp + fn + tn), 6),
        "precision": F.bround(precision, 6),
        "recall": F.bround(recall, 6),
        "f1": F.bround(scores.ratio(2 * precision * recall, precision + recall), 6),
    }


def confusion_metrics(preds: DataFrame, threshold: float = 0.5, group: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and Brier score."""
    hit, positive = F.col("probability") >= threshold, F.col("actual") == 1
    counted = preds.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"),
        _count(hit & positive).alias("tp"),
        _count(hit & ~positive).alias("fp"),
        _count(~hit & positive).alias("fn"),
        _count(~hit & ~positive).alias("tn"),
        F.sum(F.pow(F.col("probability") - F.col("actual"), F.lit(2))).alias("_sq"),
    )
    n = F.col("rows")
    return counted.select(
        *group,
        "rows",
        F.bround(scores.ratio(F.col("tp") + F.col("fn"), n), 6).alias("positive_rate"),
        *[c.alias(k) for k, c in _rates(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]).items()],
        F.bround(F.coalesce(F.try_divide("_sq", n), F.lit(0.0)), 6).alias("brier_score"),
    )


def roc_auc(preds: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties at half; 0.5 when only one class is there.

    Rows are counted per distinct score first. Running sums are taken inside fine score buckets and then over the
    buckets, so no task ever walks all distinct scores.
    """
    by_score = preds.groupBy(*group, "probability").agg(
        F.sum("actual").cast("double").alias("pos"), F.sum(1 - F.col("actual")).cast("double").alias("neg")
    )
    return _area(by_score, list(group))


def score_counts(preds: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct score and label: the form in which predictions of a period are kept for later metrics.

    Counts of periods add up (``merge_counts``); AUC, curves and calibration of any union of periods follow from them exactly.
    """
    return preds.groupBy(*group, "probability", "actual").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(stored: DataFrame) -> DataFrame:
    return stored.groupBy(*[c for c in stored.columns if c != "n"]).agg(F.sum("n").alias("n"))


def auc_of_counts(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` of score counts."""
    n = F.col("n") * F.when(F.col("actual") == 1, 1).otherwise(0)
    by_score = counts.groupBy(*group, "probability").agg(F.sum(n).cast("double").alias("pos"), F.sum(F.col("n") - n).cast("double").alias("neg"))
    return _area(by_score, list(group))


def _area(by_score: DataFrame, group: list[str]) -> DataFrame:
    by_score = by_score.withColumn("_bucket", F.floor(F.col("probability") * _SCORE_BUCKETS))
    inside = Window.partitionBy(*group, "_bucket").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0.0))
    per_bucket = (
        by_score.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
        .groupBy(*group, "_bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    )
    buckets = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(buckets), F.lit(0.0))
    pairs = F.sum("pos") * F.sum("neg")
    return (
        per_bucket.withColumn("won", F.col("won") + F.col("pos") * below)
        .groupBy(*group)
        .agg(F.bround(F.when(pairs > 0, F.sum("won") / pairs).otherwise(F.lit(0.5)), 6).alias("roc_auc"))
    )


def top_decile_precision(preds: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean label of the top ``max(1, ceil(n / 10))`` scores, ties in (time, id) order."""
    levels = score_levels(F.col("probability"), F.col("t"), F.col("row_id"))
    cuts = cut_keys(preds, group, levels, lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(0.1))))
    if group:
        top = with_group(preds, cuts, list(group)).where(key_struct(levels) <= F.col("cut"))
    else:
        top = preds.where(key_struct(levels) <= cuts.select("cut").scalar())
    return top.groupBy(*group).agg(F.bround(F.coalesce(F.avg("actual"), F.lit(0.0)), 6).alias("top_decile_precision"))


def classification_metrics(preds: DataFrame, threshold: float = 0.5, group: Sequence[str] = ()) -> DataFrame:
    """All seven metrics, one row per group (one row without groups)."""
    parts = [confusion_metrics(preds, threshold, group), roc_auc(preds, group), top_decile_precision(preds, group)]
    columns = [c for part in parts for c in part.columns if c not in group]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.groupBy(*group).agg(*[F.max(c).alias(c) for c in columns])


def named_group(column: str) -> Column:
    """Group name as text, ``unknown`` for missing or empty."""
    name = F.col(column).cast("string")
    return F.coalesce(F.when(name != "", name), F.lit("unknown"))


def group_metrics(preds: DataFrame, column: str, threshold: float = 0.5) -> DataFrame:
    return classification_metrics(preds.withColumn("group", named_group(column)), threshold, ["group"])


def threshold_curve(preds: DataFrame, thresholds: Sequence[float] = C.THRESHOLDS, group: Sequence[str] = ()) -> DataFrame:
    """Alerts and confusion rates per threshold, from one pass that counts rows per (score band, label)."""
    return curve_of_counts(preds.withColumn("n", F.lit(1)), thresholds, group)


def curve_of_counts(counts: DataFrame, thresholds: Sequence[float] = C.THRESHOLDS, group: Sequence[str] = ()) -> DataFrame:
    """``threshold_curve`` of score counts."""
    group = list(group)
    fired = sum((F.col("probability") >= t).cast("int") for t in thresholds)
    bands = counts.groupBy(*group, fired.alias("_fired"), "actual").agg(F.sum("n").alias("n"))
    marks = F.array(
        *[F.struct(F.lit(i).alias("_i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(sorted(thresholds))]
    )
    long = bands.select("*", F.inline(marks))
    hit, positive = F.col("_fired") > F.col("_i"), F.col("actual") == 1

    def rows_where(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    counted = long.groupBy(*group, "threshold").agg(
        rows_where(hit & positive).alias("tp"),
        rows_where(hit & ~positive).alias("fp"),
        rows_where(~hit & positive).alias("fn"),
        rows_where(~hit & ~positive).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counted.select(
        *group,
        F.round("threshold", 3).alias("threshold"),
        (tp + fp).cast("bigint").alias("predicted_positive"),
        F.bround(scores.ratio(tp + fp, tp + fp + fn + tn), 6).alias("alert_rate"),
        *[c.alias(k) for k, c in _rates(tp, fp, fn, tn).items()],
    )


def calibration_bins(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width score bins (the last one closed); empty bins are zeros."""
    return bins_of_counts(preds.withColumn("n", F.lit(1)), bins)


def bins_of_counts(counts: DataFrame, bins: int = 10) -> DataFrame:
    """``calibration_bins`` of score counts."""
    index = sum((F.col("probability") >= i / bins).cast("int") for i in range(1, bins))
    rows = F.sum("n")
    counted = counts.groupBy(index.alias("bin_index")).agg(
        rows.alias("rows"), (F.sum(F.col("probability") * F.col("n")) / rows).alias("_p"), (F.sum(F.col("actual") * F.col("n")) / rows).alias("_y")
    )
    edges = counts.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin_index"),
        F.format_string("%.1f-%.1f", F.col("id") / bins, (F.col("id") + 1) / bins).alias("bin"),
    )
    full = edges.join(counted, "bin_index", "left")
    return full.select(
        "bin_index",
        "bin",
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
        F.bround(F.coalesce("_p", F.lit(0.0)), 6).alias("avg_predicted"),
        F.bround(F.coalesce("_y", F.lit(0.0)), 6).alias("actual_rate"),
        F.bround(F.coalesce(F.abs(F.col("_p") - F.col("_y")), F.lit(0.0)), 6).alias("abs_error"),
    )


def calibration_error(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Row-weighted mean distance between predicted and actual rate over the bins."""
    index = sum((F.col("probability") >= i / bins).cast("int") for i in range(1, bins))
    counted = preds.groupBy(index.alias("_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.avg("probability") - F.avg("actual")).alias("gap")
    )
    return counted.agg(
        F.bround(F.coalesce(F.try_divide(F.sum(F.col("gap") * F.col("n")), F.sum("n")), F.lit(0.0)), 6).alias("expected_calibration_error")
    )


def max_station_seq(rows: DataFrame) -> DataFrame:
    return rows.groupBy("canonical_route_name").agg(F.max("station_seq").alias("max_station_seq"))


def with_segment(preds: DataFrame, max_seq: DataFrame) -> DataFrame:
    """Quarter of the route each row's stop lies in."""
    joined = preds.join(max_seq, "canonical_route_name", "left")
    return joined.withColumn("segment", scores.segment(F.col("station_seq"), F.col("max_station_seq"))).drop("max_station_seq")


def segment_order(column: str = "segment") -> Column:
    order = F.lit(99)
    for i, name in enumerate(C.SEGMENTS):
        order = F.when(F.col(column) == name, i).otherwise(order)
    return order


def segment_metrics(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    return classification_metrics(preds, threshold, ["segment"]).withColumn("segment_order", segment_order())


def segment_thresholds(preds: DataFrame) -> DataFrame:
    """Per segment the threshold with the best (F1, precision, threshold), and how 0.9 does."""
    curve = threshold_curve(preds, C.SEGMENT_THRESHOLDS, ["segment"])
    default = F.col("threshold") == 0.9
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1", "alert_rate"), F.struct("f1", "precision", "threshold"))
    chosen = curve.groupBy("segment").agg(
        best.alias("_best"),
        F.max(F.when(default, F.col("precision"))).alias("default09_precision"),
        F.max(F.when(default, F.col("recall"))).alias("default09_recall"),
        F.max(F.when(default, F.col("f1"))).alias("default09_f1"),
    )
    sizes = preds.groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.bround(F.avg("actual"), 6).alias("positive_rate")
    )
    return sizes.join(chosen, "segment").select(
        "segment",
        "rows",
        "positive_rate",
        *[F.col(f"_best.{c}").alias(f"recommended_{c}") for c in ("threshold", "precision", "recall", "f1", "alert_rate")],
        "default09_precision",
        "default09_recall",
        "default09_f1",
    )


def operating_policy(curve: DataFrame, segments: DataFrame) -> DataFrame:
    """Default 0.9 and precision-mode 0.95 thresholds (else the best F1), and the terminal segment's own."""
    best = F.max_by("threshold", F.struct("f1", (-F.col("threshold")).alias("t")))

    def at(threshold, column):
        return F.max(F.when(F.col("threshold") == threshold, F.col(column)))

    policy = curve.agg(
        F.coalesce(at(0.9, "threshold"), best).alias("default_threshold"),
        F.coalesce(at(0.95, "threshold"), best).alias("precision_mode_threshold"),
        at(0.9, "precision").alias("balanced_precision"),
        at(0.9, "recall").alias("balanced_recall"),
        at(0.9, "f1").alias("balanced_f1"),
        at(0.9, "alert_rate").alias("balanced_alert_rate"),
        at(0.95, "precision").alias("precision_mode_precision"),
        at(0.95, "recall").alias("precision_mode_recall"),
    )
    terminal = segments.where("segment = 'terminal_75_100'").agg(F.max("recommended_threshold").alias("v")).scalar()
    return policy.withColumn("terminal_segment_threshold", terminal)


def class_weights(rows: DataFrame, target: str) -> DataFrame:
    """One row: n / (2 * class size) per class, 1 for an absent class."""
    n, pos = F.count(F.lit(1)), F.coalesce(F.sum(target), F.lit(0))
    return rows.agg(
        n.alias("rows"),
        pos.cast("bigint").alias("positives"),
        F.when(pos > 0, n / (2 * pos)).otherwise(F.lit(1.0)).alias("positive_weight"),
        F.when(n - pos > 0, n / (2 * (n - pos))).otherwise(F.lit(1.0)).alias("negative_weight"),
    )


def platt_inputs(preds: DataFrame) -> DataFrame:
    return preds.withColumn("logit", scores.logit(F.col("probability")))
