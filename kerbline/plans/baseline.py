"""Historical-rate baseline: split by time, learn smoothed rates, evaluate."""

from pyspark.sql import DataFrame, functions as F

from kerbline import constants as C
from kerbline.operators import metrics, rates, split
from kerbline.plans.model import as_predictions
from kerbline.session import cut_lineage


def evaluate(rows: DataFrame, *, target: str = C.DEFAULT_TARGET, test_ratio: float = 0.2, threshold: float = 0.5) -> DataFrame:
    """One row: sizes, positive rate and the seven metrics on the latest rows."""
    micros, row_id = F.unix_micros("collected_at"), F.col("snapshot_id")
    cut = split.chronological_cut(rows, micros, row_id, test_ratio)
    in_train = split.before_cut(micros, row_id, cut)
    known = rates.smoothed_rates(rows.where(in_train), target)
    preds = cut_lineage(as_predictions(rates.historical_probability(rows.where(~in_train), known), target, threshold))
    found = metrics.classification_metrics(preds, threshold).drop("rows", "positive_rate")
    positive_rate = rows.agg(F.bround(F.avg(target), 6)).scalar()
    return found.select(
        F.lit(target).alias("target_column"),
        F.lit(cut["rows"]).alias("total_rows"),
        F.lit(cut["train"]).alias("train_rows"),
        F.lit(cut["rows"] - cut["train"]).alias("test_rows"),
        positive_rate.alias("positive_rate"),
        *found.columns,
        F.lit(rates.STRATEGY).alias("strategy"),
    )
