"""Back-test of the schedule prior: hide the test rows' bus state, score proxies from the past instead."""

from pyspark.sql import DataFrame, functions as F

from kerbline import constants as C
from kerbline.functions import scores
from kerbline.operators import metrics, proxy, split
from kerbline.plans import model as M
from kerbline.session import cut_lineage, held

SAMPLE = (
    "snapshot_id", "collected_at_kst", "canonical_route_name", "station_id", "station_name", "station_seq", "hour", "actual_remain_seat_cnt",
    "remain_seat_cnt", "actual_crowded", "crowded", "historical_proxy_group", "historical_proxy_rows", "proxy_confidence", "actual", "probability", "predicted",
)


def proxied_test_rows(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Test rows with the bus state replaced by what the training rows suggest."""
    known = proxy.proxy_statistics(train, target)
    seen = test.withColumns({"actual_remain_seat_cnt": F.col("remain_seat_cnt"), "actual_crowded": F.col("crowded")})
    hidden = proxy.hide_bus_state(proxy.with_proxy(seen, known), F.col("estimated_capacity"), "scheduled_proxy_backtest")
    confidence = scores.proxy_confidence(F.col("historical_proxy_group"), F.col("historical_proxy_rows"))
    return hidden.withColumn("proxy_confidence", confidence)


def run(
    rows: DataFrame, *, target: str = C.DEFAULT_TARGET, test_ratio: float = 0.2, threshold: float = 0.9, max_test_rows: int | None = None, **settings
) -> dict:
    """Train on the past, score proxies of the later rows, break results down by fallback level and confidence."""
    rows = cut_lineage(rows)
    micros, row_id = F.unix_micros("collected_at"), F.col("snapshot_id")
    cut = split.chronological_cut(rows, micros, row_id, test_ratio)
    if cut["rows"] < 20:
        raise ValueError("the back-test needs at least 20 labelled rows")
    early = split.before_cut(micros, row_id, cut)
    train, test = rows.where(early), rows.where(~early)
    if max_test_rows:
        test = split.earliest_test_rows(test, micros, row_id, max_test_rows)
    needed = held(M.lean(train, target))
    choice = M.choose_features(needed)
    fitted = M.fit(needed, target, M.boosting(**settings), choice)
    needed.unpersist()
    scored = M.with_probability(fitted, proxied_test_rows(train, test, target))
    preds = cut_lineage(M.as_predictions(scored, target, threshold))
    sample = preds.select(*SAMPLE[:-2], F.bround("probability", 6).alias("probability"), "predicted", "t", "row_id")
    return {
        "sizes": cut,
        "choice": choice,
        "predictions": preds,
        "metrics": metrics.classification_metrics(preds, threshold),
        "threshold_curve": metrics.threshold_curve(preds),
        "calibration": metrics.calibration_bins(preds),
        "fallback_metrics": metrics.group_metrics(preds, "historical_proxy_group", threshold),
        "confidence_metrics": metrics.group_metrics(preds, "proxy_confidence", threshold),
        "top_risk_samples": sample.orderBy(F.col("probability").desc(), "t", "row_id").limit(20).drop("t", "row_id"),
        "missed_samples": sample.where("actual = 1 AND predicted = 0").orderBy("probability", "t", "row_id").limit(20).drop("t", "row_id"),
    }
