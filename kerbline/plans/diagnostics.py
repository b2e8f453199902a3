"""Model diagnostics: ablations, per-route splits, calibration and the boosting comparison."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from kerbline import constants as C
from kerbline.functions import scores
from kerbline.operators import metrics, split
from kerbline.plans import model as M
from kerbline.session import cut_lineage, held

# Ablation variants and the group each leaves out.
VARIANTS = (
    ("full", ()), ("no_bus_state", ("bus_state",)), ("no_weather", ("weather",)), ("no_route", ("route",)), ("no_time", ("time",)), ("no_station_seq", ("station_seq",)),
)


def _micros():
    return F.unix_micros("collected_at")


def _row_id():
    return F.col("snapshot_id")


def time_split(rows: DataFrame, test_ratio: float) -> tuple[DataFrame, DataFrame]:
    cut = split.chronological_cut(rows, _micros(), _row_id(), test_ratio)
    early = split.before_cut(_micros(), _row_id(), cut)
    return rows.where(early), rows.where(~early)


def fit_and_score(
    train: DataFrame, test: DataFrame, classifier, *, target: str, threshold: float, choice_rows: DataFrame | None = None, disabled=()
) -> dict:
    """Train on one part, predict the other. Features are chosen on the training part unless ``choice_rows`` is given."""
    choice = M.choose_features(train if choice_rows is None else choice_rows, disabled)
    fitted = M.fit(train, target, classifier, choice)
    preds = cut_lineage(M.as_predictions(M.with_probability(fitted, test), target, threshold))
    return {"model": fitted, "choice": choice, "predictions": preds}


def train_logistic(rows: DataFrame, *, target: str = C.DEFAULT_TARGET, test_ratio: float = 0.2, threshold: float = 0.5, l2: float = C.LOGISTIC_L2) -> dict:
    """Class-balanced logistic regression on a time split: metrics, weights and predictions."""
    train, test = time_split(rows, test_ratio)
    done = fit_and_score(train, test, M.logistic(l2), target=target, threshold=threshold)
    return {
        "metrics": metrics.classification_metrics(done["predictions"], threshold),
        "top_features": M.top_features(done["model"], done["choice"], rows.sparkSession),
        **done,
    }


def optimality(fitted: PipelineModel, train: DataFrame, target: str, l2: float = C.LOGISTIC_L2) -> DataFrame:
    """One row: the class-weighted, L2-regularised loss at the fitted coefficients, and the largest component of its gradient.

    The loss is convex, so a gradient near zero certifies the fit whatever solver found it. One aggregate over the rows: the
    weighted sums of features are taken apart by the sign of the residual.
    """
    last = fitted.stages[-1]
    rows = fitted.transform(M.balanced(train, target))
    p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-15)), F.lit(1 - 1e-15))
    off = F.col("weight") * (p - F.col("label"))
    total = Summarizer.metrics("sum")
    found = rows.agg(
        total.summary(F.col("features"), F.greatest(off, F.lit(0.0))).alias("over"), total.summary(F.col("features"), F.greatest(-off, F.lit(0.0))).alias("under"),
        F.sum(off).alias("off"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("label").cast("long")).alias("positives"),
        F.sum(-F.col("weight") * F.log(F.when(F.col("label") == 1, p).otherwise(1 - p))).alias("loss"),
    ).first()
    coefficients = last.coefficients.toArray()
    slope = (found["over"]["sum"].toArray() - found["under"]["sum"].toArray()) / found["weight"] + l2 * coefficients
    steepest = max(abs(found["off"] / found["weight"]), float(abs(slope).max(initial=0.0)))
    loss = found["loss"] / found["weight"] + l2 / 2 * float(coefficients @ coefficients)
    kind = "rows BIGINT, positives BIGINT, weight DOUBLE, loss DOUBLE, steepest DOUBLE"
    return train.sparkSession.createDataFrame([(found["rows"], found["positives"], found["weight"], loss, steepest)], kind)


def ablations(rows: DataFrame, *, target: str, test_ratio: float = 0.2, threshold: float = 0.5, l2: float = C.LOGISTIC_L2) -> tuple[DataFrame, DataFrame]:
    """Metrics per variant, and the full variant's predictions with all columns of ``rows``."""
    needed = held(M.lean(rows, target))
    cut = split.chronological_cut(needed, _micros(), _row_id(), test_ratio)
    early = split.before_cut(_micros(), _row_id(), cut)
    train, parts, full = needed.where(early), [], None
    for name, disabled in VARIANTS:
        test = (rows if name == "full" else needed).where(~early)
        done = fit_and_score(train, test, M.logistic(l2), target=target, threshold=threshold, disabled=disabled)
        full = done["predictions"] if name == "full" else full
        names = M.feature_names(done["model"], done["choice"])
        parts.append(
            metrics.classification_metrics(done["predictions"], threshold).select(
                F.lit(name).alias("variant"), F.lit(len(names)).alias("feature_count"), "*"
            )
        )
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    needed.unpersist()
    return table, full


def route_stratified(rows: DataFrame, *, target: str, test_ratio: float = 0.2, threshold: float = 0.5, l2: float = C.LOGISTIC_L2) -> dict[str, DataFrame]:
    """As the time split, but inside each route; routes with fewer than two rows are skipped."""
    marked = cut_lineage(split.grouped_split(rows, "canonical_route_name", _micros(), _row_id(), test_ratio))
    train, test = (marked.where(F.col("split") == part).drop("split") for part in ("train", "test"))
    done = fit_and_score(train, test, M.logistic(l2), target=target, threshold=threshold)
    return {
        "overall": metrics.classification_metrics(done["predictions"], threshold),
        "routes": split.grouped_split_counts(rows, "canonical_route_name", target, test_ratio),
        "route_metrics": metrics.group_metrics(done["predictions"], "canonical_route_name", threshold),
    }


def platt_scaler(preds: DataFrame, l2: float = C.PLATT_L2) -> dict[str, float]:
    """Slope and intercept of a one-feature logistic fit on the logit."""
    rows = metrics.platt_inputs(preds).withColumn("label", F.col("actual").cast("double"))
    assembler = VectorAssembler(inputCols=["logit"], outputCol="logits")
    fitter = LogisticRegression(featuresCol="logits", labelCol="label", regParam=l2, standardization=False, tol=1e-10, maxIter=200)
    last = Pipeline(stages=[assembler, fitter]).fit(rows.select("logit", "label")).stages[-1]
    return {"a": float(last.coefficients[0]), "b": float(last.intercept)}


def apply_platt(preds: DataFrame, scaler: dict[str, float], threshold: float) -> DataFrame:
    p = scores.sigmoid(F.lit(scaler["a"]) * scores.logit(F.col("probability")) + F.lit(scaler["b"]))
    return preds.withColumn("probability", p).withColumn("predicted", (F.col("probability") >= threshold).cast("int"))


def calibration_comparison(rows: DataFrame, *, target: str, test_ratio: float = 0.2, threshold: float = 0.5, l2: float = C.LOGISTIC_L2) -> dict:
    """64/16/20 split: fit, calibrate on the middle part, compare raw and calibrated scores on the last part."""
    marked = cut_lineage(split.three_way_split(rows, _micros(), _row_id(), test_ratio))
    parts = {name: marked.where(F.col("split") == name).drop("split") for name in ("train", "calibration", "test")}
    sizes = {r["split"]: r["count"] for r in marked.groupBy("split").count().collect()}
    if sizes.get("train", 0) < 10 or sizes.get("test", 0) < 2:
        # Too little to fit and judge: metrics of no rows, under this status.
        none = rows.sparkSession.createDataFrame([], "row_id BIGINT, t BIGINT, actual INT, probability DOUBLE")
        return {"status": "skipped", "sizes": sizes, "raw_metrics": metrics.classification_metrics(none, threshold), "calibrated_metrics": metrics.classification_metrics(none, threshold)}
    choice = M.choose_features(parts["train"])
    fitted = M.fit(parts["train"], target, M.logistic(l2), choice)

    def scored(part):
        return cut_lineage(M.as_predictions(M.with_probability(fitted, parts[part]), target, threshold))

    scaler = platt_scaler(scored("calibration"))
    raw = scored("test")
    calibrated = apply_platt(raw, scaler, threshold)
    return {
        "status": "ok",
        "parameters": scaler,
        "sizes": sizes,
        "raw_metrics": metrics.classification_metrics(raw, threshold),
        "calibrated_metrics": metrics.classification_metrics(calibrated, threshold),
        "raw_error": metrics.calibration_error(raw),
        "calibrated_error": metrics.calibration_error(calibrated),
        "raw_bins": metrics.calibration_bins(raw),
        "calibrated_bins": metrics.calibration_bins(calibrated),
    }


def boosting_comparison(rows: DataFrame, *, target: str, test_ratio: float = 0.2, threshold: float = 0.5, **settings) -> dict:
    """Boosting on the same time split, with its curve, calibration, breakdowns and importances."""
    needed = held(M.lean(rows, target))
    train, test = time_split(needed, test_ratio)
    done = fit_and_score(train, test, M.boosting(**settings), target=target, threshold=threshold)
    needed.unpersist()
    preds = done["predictions"]
    return {
        "metrics": metrics.classification_metrics(preds, threshold),
        "threshold_curve": metrics.threshold_curve(preds),
        "calibration": metrics.calibration_bins(preds),
        "route_metrics": metrics.group_metrics(preds, "canonical_route_name", threshold),
        "period_metrics": metrics.group_metrics(preds, "time_period", threshold),
        "top_features": M.top_features(done["model"], done["choice"], rows.sparkSession),
    }


def report(rows: DataFrame, *, target: str = C.DEFAULT_TARGET, test_ratio: float = 0.2, threshold: float = 0.5, **settings) -> dict:
    """Everything above as one dictionary of small frames."""
    rows = cut_lineage(rows)
    options = {"target": target, "test_ratio": test_ratio, "threshold": threshold}
    table, full = ablations(rows, **options)
    segmented = metrics.with_segment(full, metrics.max_station_seq(rows))
    curve, segments = metrics.threshold_curve(full), metrics.segment_thresholds(segmented)
    return {
        "ablations": table,
        "route_metrics": metrics.group_metrics(full, "canonical_route_name", threshold),
        "period_metrics": metrics.group_metrics(full, "time_period", threshold),
        "segment_metrics": metrics.segment_metrics(segmented, threshold),
        "segment_thresholds": segments,
        "threshold_curve": curve,
        "operating_policy": metrics.operating_policy(curve, segments),
        "calibration": metrics.calibration_bins(full),
        "calibration_error": metrics.calibration_error(full),
        "route_stratified": route_stratified(rows, **options),
        "calibration_model": calibration_comparison(rows, **options),
        "boosting": boosting_comparison(rows, **options, **settings),
    }
