"""Training, validating and applying the instability models with MLlib."""

from __future__ import annotations

import json
import statistics
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators.features import time_folds
from wattloom.operators.stats import classification_report
from wattloom.series import Series

MIN_TRAINING_ROWS = 500
# fixed values: messages of the training checks
MSG_TOO_FEW = "Zu wenige Daten ({n}/{needed}). Benötigt mindestens {needed} Datenpunkte."
MSG_TOO_FEW_CLEAN = "Nach Bereinigung zu wenige Daten ({n})."


@dataclass
class Trained:
    """Result of a training; ``model`` is None where it failed."""

    success: bool
    error: str | None = None
    model: PipelineModel | None = None
    features: list[str] = field(default_factory=list)
    metrics: dict[str, float] = field(default_factory=dict)
    importances: dict[str, float] = field(default_factory=dict)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = n / (classes * rows of the class).

    The counts of the classes - two rows - go into the expression, so the training rows
    need no join.
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = reduce(
        lambda acc, kv: acc.when(F.col(label) == kv[0], total / (len(counts) * kv[1])), counts.items(), F.when(F.lit(False), 0.0)
    )
    return df.withColumn("weight", weight)


def forest(features: Sequence[str], label: str, trees: int = 100, depth: int = 10, seed: int = 42, weight: str | None = None) -> Pipeline:
    classifier = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    if weight:
        classifier = classifier.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), classifier])


#: rows above which trees are grown on evenly dealt partitions, and rows of such a partition at most
PART_ROWS = 250_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """The rows in even partitions of at most ``PART_ROWS``, in a fixed order.

    Features come in the partitions of their windows, a few large ones; each level of the trees reads all of them.
    """
    if rows <= PART_ROWS:
        return df
    n = max(-(-rows // PART_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # trees draw rows by their position
    return df.repartition(n).sortWithinPartitions(*df.columns)


def _fit(df: DataFrame, features: Sequence[str], label: str, trees: int, depth: int, seed: int, balanced: bool) -> PipelineModel:
    used = balanced_weights(df, label).select(*features, label, "weight") if balanced else df.select(*features, label)
    dealt = spread(used, df.count())
    if dealt is not used:
        dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return forest(features, label, trees, depth, seed, "weight" if balanced else None).fit(dealt)
    finally:
        if dealt is not used:
            dealt.unpersist()


def importances_of(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, (float(x) for x in model.stages[-1].featureImportances.toArray())))


def train_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str = "target",
    s: Series | None = None,
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
    min_rows: int = MIN_TRAINING_ROWS,
    folds: int = 5,
    balanced: bool = True,
) -> Trained:
    """Fit a random forest on the complete rows; with ``s`` also cross-validate over time."""
    # growing the trees reads the rows once per level, so the features are computed once
    places = [] if s is None else [*s.keys, s.ts]
    kept = df.select(*dict.fromkeys([*places, *features, label])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*features, label)])
        stats = kept.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(complete).alias("n"),
            F.avg(F.when(complete, F.col(label).cast("double"))).alias("p"),
        ).first()
        if stats["rows"] < min_rows:
            return Trained(False, MSG_TOO_FEW.format(n=stats["rows"], needed=min_rows))
        if stats["n"] < min_rows:
            return Trained(False, MSG_TOO_FEW_CLEAN.format(n=stats["n"]))
        clean = kept.filter(complete)
        metrics = {"training_samples": float(stats["n"]), "positive_rate": float(stats["p"])}
        if s is not None and folds:
            metrics |= cross_validate_f1(clean, features, label, s, folds, trees, depth, seed, balanced)
        model = _fit(clean, features, label, trees, depth, seed, balanced)
    finally:
        kept.unpersist()
    return Trained(True, None, model, list(features), metrics, importances_of(model, features))


def cross_validate_f1(df: DataFrame, features: Sequence[str], label: str, s: Series, folds: int = 5, trees: int = 100, depth: int = 10, seed: int = 42, balanced: bool = True) -> dict[str, float]:
    """Mean and population std of the F1 score over contiguous folds."""
    narrow = df.select(*dict.fromkeys([*s.keys, s.ts, *features, label]))
    folded = time_folds(narrow, s, label, folds).persist(StorageLevel.MEMORY_AND_DISK)

    def f1(k: int) -> float:
        model = _fit(folded.filter(F.col("fold") != k), features, label, trees, depth, seed, balanced)
        scored = model.transform(folded.filter(F.col("fold") == k))
        report = classification_report(scored.withColumn("prediction", F.col("prediction").cast("int")), label)
        return report.filter("class = '1'").first()["f1"]

    try:
        folded.count()
        with ThreadPool(folds) as pool:
            scores = pool.map(inheritable_thread_target(df.sparkSession)(f1), range(folds), chunksize=1)
    finally:
        folded.unpersist()
    return {"f1_mean": statistics.fmean(scores), "f1_std": statistics.pstdev(scores)}


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds the probability of class 1 and the decision."""
    out = model.transform(df)
    probability = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))
    out = out.withColumns({"p": probability, "prediction": F.col("prediction").cast("int")})
    return out.withColumn("predicted", F.col("p") > threshold).drop("features", "rawPrediction", "probability")


def predict_latest(trained: Trained | None, featured: DataFrame, s: Series) -> DataFrame:
    """The probability of cycling for the newest complete row of every series."""
    keys = list(s.keys)
    everyone = featured.select(*keys).distinct()
    if trained is None or trained.model is None:
        return everyone.select(
            *keys,
            F.lit(False).alias("cycling_predicted"),
            F.lit(0.0).alias("probability"),
            F.lit(0.0).alias("confidence"),
            F.lit("model_not_trained").alias("status"),
        )
    names = trained.features
    complete = featured.na.drop(subset=names)
    newest = complete.groupBy(*keys).agg(F.max_by(F.struct(*names), s.ts).alias("_x")).select(*keys, "_x.*")
    scored = score(trained.model, newest).select(*keys, "p", "predicted")
    joined = everyone.join(scored, keys, "left")
    return joined.select(
        *keys,
        F.coalesce("predicted", F.lit(False)).alias("cycling_predicted"),
        F.coalesce("p", F.lit(0.0)).alias("probability"),
        F.when(F.col("p").isNotNull(), trained.metrics.get("f1_mean", 0.0)).otherwise(0.0).alias("confidence"),
        F.when(F.col("p").isNotNull(), "ok").otherwise("no_valid_features").alias("status"),
    )


def feature_importance(spark: SparkSession, trained: Trained, top: int | None = None) -> DataFrame:
    """(feature, importance), the largest first."""
    ranked = sorted(trained.importances.items(), key=lambda kv: (-kv[1], kv[0]))[:top]
    return spark.createDataFrame(ranked, "feature string, importance double")


def save_model(trained: Trained, path: str, spark: SparkSession) -> None:
    """The fitted pipeline, and metrics and importances beside it."""
    trained.model.write().overwrite().save(f"{path}/model")
    about = {"features": trained.features, "metrics": trained.metrics, "importances": trained.importances}
    spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> Trained:
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    model = PipelineModel.load(f"{path}/model")
    return Trained(True, None, model, about["features"], about["metrics"], about["importances"])
