"""Full-seat risk models with Spark ML: feature choice, encoding, training, artifacts and scoring."""

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline import constants as C
from kerbline.functions import scores, text
from kerbline.operators import metrics

LIVE_CONTEXT = (
    "prediction_mode", "service_date", "day_name_ko", "is_holiday", "holiday_name", "requested_station_id", "requested_station_name",
    "input_at_kst", "arrival_slot", "predict_time", "predict_time_sec", "feature_source", "matched_location", "schedule_source",
    "schedule_service_date", "schedule_day_type", "schedule_direction", "schedule_first_time", "schedule_last_time",
    "schedule_allocation_minutes", "scheduled_operating", "schedule_proxy_at_kst", "schedule_proxy_time_basis",
    "historical_proxy_group", "historical_proxy_rows", "historical_next_station_full_rate", "historical_now_full_rate",
    "proxy_remain_source", "proxy_remain_seat_cnt", "proxy_crowded", "proxy_capacity",
)


@dataclass
class FeatureChoice:
    """Groups that go into the model, and why the others do not."""

    included: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)

    @property
    def numeric(self) -> list[str]:
        return [c for g in self.included for c in C.MODEL_FEATURE_GROUPS[g][0]]

    @property
    def categorical(self) -> list[str]:
        return [c for g in self.included for c in C.MODEL_FEATURE_GROUPS[g][1]]


def choose_features(rows: DataFrame, disabled: Sequence[str] = ()) -> FeatureChoice:
    """Drop groups that are disabled or too often imputed; all shares come from one aggregate row."""
    shares = rows.agg(
        *[F.coalesce(F.avg(F.coalesce(flag, F.lit(1))), F.lit(1.0)).alias(group) for group, (flag, _) in C.GATED_GROUPS.items()]
    ).first()
    choice = FeatureChoice()
    for group in C.MODEL_FEATURE_GROUPS:
        gated = group in C.GATED_GROUPS and shares[group] > C.GATED_GROUPS[group][1]
        (choice.excluded if gated or group in disabled else choice.included).append(group)
    return choice


def lean(rows: DataFrame, target: str) -> DataFrame:
    """The columns that splits, features, their gates and metrics by group look at; the others go."""
    wanted = {"snapshot_id", "collected_at", "hour", "day_of_week", target, *(flag for flag, _ in C.GATED_GROUPS.values())}
    wanted.update(c for numeric, categorical in C.MODEL_FEATURE_GROUPS.values() for c in numeric + categorical)
    return rows.select(*(c for c in rows.columns if c in wanted))


def with_cyclic_time(rows: DataFrame) -> DataFrame:
    hour, day = scores.cyclic(F.col("hour"), 24.0), scores.cyclic(F.col("day_of_week"), 7.0)
    return rows.withColumns({"hour_sin": hour[0], "hour_cos": hour[1], "day_sin": day[0], "day_cos": day[1]})


def encoder_stages(train: DataFrame, choice: FeatureChoice) -> list:
    """Standardised numerics (population deviation, 0 counts as 1) and sorted one-hot blocks; unseen text is all zeros.

    Means and deviations are one aggregate row and become constants of a SQL stage.
    """
    cyclic = {"hour_sin", "hour_cos", "day_sin", "day_cos"}
    moments = with_cyclic_time(train).agg(
        *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"m_{c}") for c in choice.numeric],
        *[F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"s_{c}") for c in choice.numeric],
        F.count(F.lit(1)).alias("n"),
    ).first()
    turns = {
        "hour_sin": "sin(2 * pi() * hour / 24)", "hour_cos": "cos(2 * pi() * hour / 24)",
        "day_sin": "sin(2 * pi() * day_of_week / 7)", "day_cos": "cos(2 * pi() * day_of_week / 7)",
    }
    scaled = []
    for c in choice.numeric:
        value = turns[c] if c in cyclic else f"coalesce(CAST({c} AS DOUBLE), 0D)"
        mean, deviation = moments[f"m_{c}"] or 0.0, moments[f"s_{c}"] or 1.0
        scaled.append(f"({value} - ({mean!r}D)) / {deviation!r}D AS z_{c}")
    named = [f"coalesce(nullif(CAST({c} AS STRING), ''), 'unknown') AS c_{c}" for c in choice.categorical]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(scaled + named)} FROM __THIS__")]
    for c in choice.categorical:
        stages.append(StringIndexer(inputCol=f"c_{c}", outputCol=f"i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"i_{c}", outputCol=f"v_{c}", dropLast=True))
    inputs = [f"z_{c}" for c in choice.numeric] + [f"v_{c}" for c in choice.categorical]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def feature_names(model: PipelineModel, choice: FeatureChoice) -> list[str]:
    labels = {s.getOutputCol()[2:]: s.labels for s in model.stages if hasattr(s, "labels")}
    return choice.numeric + [f"{c}={v}" for c in choice.categorical for v in labels[c]]


def balanced(train: DataFrame, target: str) -> DataFrame:
    """Adds ``label`` and ``weight`` (n / twice the class size)."""
    row = metrics.class_weights(train, target).first()
    weight = F.when(F.col(target) == 1, row["positive_weight"]).otherwise(row["negative_weight"])
    return train.withColumns({"label": F.col(target).cast("double"), "weight": weight})


def boosting(**settings) -> GBTClassifier:
    return GBTClassifier(labelCol="label", weightCol="weight", featuresCol="features", **{**C.BOOSTING, **settings})


def logistic(l2: float = C.LOGISTIC_L2) -> LogisticRegression:
    return LogisticRegression(labelCol="label", weightCol="weight", featuresCol="features", regParam=l2, elasticNetParam=0.0, standardization=False)


def fit(train: DataFrame, target: str, classifier, choice: FeatureChoice) -> PipelineModel:
    return Pipeline(stages=[*encoder_stages(train, choice), classifier]).fit(balanced(train, target))


def with_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows plus ``probability``; the model's working columns are dropped."""
    scored = model.transform(rows)
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("p")).withColumnRenamed("p", "probability")


def as_predictions(scored: DataFrame, target: str, threshold: float) -> DataFrame:
    """What the metrics need: id, time, label, decision."""
    return scored.withColumns(
        {
            "row_id": F.col("snapshot_id"),
            "t": F.unix_micros("collected_at"),
            "actual": F.col(target).cast("int"),
            "predicted": (F.col("probability") >= threshold).cast("int"),
        }
    )


def top_features(model: PipelineModel, choice: FeatureChoice, spark: SparkSession, most: int = 30) -> DataFrame:
    """Largest importances (trees) or absolute weights (logistic)."""
    last = model.stages[-1]
    names = feature_names(model, choice)
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(n, float(v), abs(float(v))) for n, v in zip(names, values.toArray())]
    frame = spark.createDataFrame(rows, "feature STRING, weight DOUBLE, importance DOUBLE")
    rounded = frame.select("feature", F.bround("weight", 6).alias("weight"), F.bround("importance", 6).alias("importance"))
    return rounded.orderBy(F.col("importance").desc(), "feature").limit(most)


REQUIRED = ("version", "threshold", "target_column", "included_groups")


def train_artifact(rows: DataFrame, path: str, *, target: str = C.DEFAULT_TARGET, threshold: float = 0.9, **settings) -> DataFrame:
    """Train boosting on all labelled rows and save it; returns the one-row summary. At least ten rows are needed."""
    spark = rows.sparkSession
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("rate")).first()
    if totals["n"] < 10:
        raise ValueError("training needs at least 10 labelled rows")
    choice = choose_features(rows)
    model = fit(rows, target, boosting(**settings), choice)
    model.write().overwrite().save(f"{path}/model")
    metrics.max_station_seq(rows).write.mode("overwrite").parquet(f"{path}/max_station_seq")
    meta = {
        "version": C.ARTIFACT_VERSION,
        "target_column": target,
        "threshold": float(threshold),
        "model_name": type(model.stages[-1]).__name__,
        "training_rows": totals["n"],
        "positive_rate": round(totals["rate"], 6),
        "feature_count": len(feature_names(model, choice)),
        "included_groups": choice.included,
        "excluded_groups": choice.excluded,
    }
    summary = spark.createDataFrame([(json.dumps(meta),)], "value STRING")
    summary.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    top_features(model, choice, spark).write.mode("overwrite").json(f"{path}/top_features")
    return spark.createDataFrame([meta], "version STRING, target_column STRING, threshold DOUBLE, model_name STRING, training_rows BIGINT, "
        "positive_rate DOUBLE, feature_count INT, included_groups ARRAY<STRING>, excluded_groups ARRAY<STRING>")


@dataclass
class Artifact:
    model: PipelineModel
    meta: dict
    max_seq: DataFrame


def load_artifact(spark: SparkSession, path: str) -> Artifact:
    """Read a saved model; an artifact without a required field is refused."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    missing = sorted(set(REQUIRED) - set(meta))
    if missing:
        raise ValueError(f"not a risk artifact, missing: {', '.join(missing)}")
    return Artifact(PipelineModel.load(f"{path}/model"), meta, spark.read.parquet(f"{path}/max_station_seq"))


def score(artifact: Artifact, rows: DataFrame) -> DataFrame:
    """Risk rows with camel-case names: probability, score, flag, level, segment and any context the rows carry."""
    threshold = artifact.meta["threshold"]
    scored = metrics.with_segment(with_probability(artifact.model, rows), artifact.max_seq)
    p = F.col("probability")
    kept = [c for c in LIVE_CONTEXT + ("request_id",) if c in rows.columns]
    named = scored.select(
        "snapshot_id", "collected_at_kst", "observed_hour_kst", "route_id", F.col("canonical_route_name").alias("route_name"), "plate_no",
        "station_id", "station_name", "station_seq", F.col("segment").alias("station_seq_segment"), "remain_seat_cnt", "crowded", "crowded_label",
        F.bround(p, 6).alias("full_seat_probability"),
        F.bround(p * 100, 2).alias("full_seat_risk_score"),
        F.lit(threshold).alias("threshold"),
        (p >= threshold).alias("is_full_risk"),
        scores.risk_level(p, threshold).alias("risk_level"),
        F.lit(artifact.meta["model_name"]).alias("model_name"),
        F.lit(artifact.meta["version"]).alias("model_version"),
        F.array(*map(F.lit, artifact.meta["included_groups"])).alias("feature_groups"),
        *kept,
    )
    return named.toDF(*[text.camel_case(c) for c in named.columns])
