"""Density clusters against all pairs of a small set; sampling and validation properties."""

import random

import naive
import pytest
from pyspark.sql import functions as F

from wattloom.operators import clusters, features, ml
from wattloom.plans import analysis
from wattloom.series import Series


def cloud(seed, n, step):
    rng = random.Random(seed)
    centres = [(0, 0), (1.2, 0.3), (-1, 1), (3, -2)]
    out = []
    for _ in range(n):
        cx, cy = rng.choice(centres)
        spread = rng.choice([0.05, 0.3, 0.9])
        x, y = rng.gauss(cx, spread), rng.gauss(cy, spread)
        out.append((round(x / step) * step, round(y / step) * step) if step else (x, y))
    return out


@pytest.mark.parametrize("seed,n,step,eps,k", [(1, 400, 0, 0.15, 6), (2, 500, 0.0625, 0.2, 12), (3, 300, 0, 0.4, 30), (4, 60, 0, 0.01, 2)])
def test_dbscan(spark, seed, n, step, eps, k):
    pts = cloud(seed, n, step)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "i int, x double, y double")
    got = {r.i: r for r in clusters.dbscan(df, ["x", "y"], eps, k).collect()}
    core, comp, reach = naive.dbscan(pts, eps, k)
    assert [got[i].is_core for i in range(n)] == core
    names = {}
    for i in range(n):
        if core[i]:
            assert names.setdefault(comp[i], got[i].cluster) == got[i].cluster
        elif reach[i]:
            assert got[i].cluster >= 0
        else:
            assert got[i].cluster == -1
    assert len(set(names.values())) == len(names)
    for i in range(n):
        if not core[i] and reach[i]:
            assert got[i].cluster == min(names[c] for c in reach[i])


def test_missing_coordinates_are_noise(spark):
    df = spark.createDataFrame([(0.0, 0.0)] * 5 + [(None, 0.0)], "x double, y double")
    got = {(r.x, r.cluster, r.is_core) for r in clusters.dbscan(df, ["x", "y"], 0.5, 3).collect()}
    assert got == {(0.0, 0, True), (None, -1, False)}


@pytest.fixture(scope="module")
def classes(spark):
    return spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("target")).persist()


def test_split_is_exact_and_repeatable(classes):
    a = features.stratified_split(classes, ["id"])
    got = {(r.target, r.is_train): r["count"] for r in a.groupBy("target", "is_train").count().collect()}
    assert got == {(0, True): 630, (0, False): 270, (1, True): 70, (1, False): 30}
    again = features.stratified_split(classes.repartition(7), ["id"])
    assert a.exceptAll(again).isEmpty()


def test_balancing(classes):
    drawn = features.balance_classes(classes, ["id"])
    assert {r.target: r["count"] for r in drawn.groupBy("target").count().collect()} == {0: 100, 1: 100}
    # with replacement: some rows of the small class come more than once
    assert drawn.filter("target = 1").distinct().count() < 100
    assert drawn.join(classes, ["id", "target"], "left_anti").isEmpty()
    down = features.balance_classes(classes, ["id"], replacement=False)
    assert down.groupBy("target").count().filter("count <> 100").isEmpty()
    assert down.filter("target = 1").distinct().count() == 100


@pytest.fixture(scope="module")
def history(minutes):
    rng = random.Random(42)
    values = []
    while len(values) < 1500:
        values += [max(0, rng.gauss(600, 100)) for _ in range(rng.randint(5, 29))]
        values += [max(0, rng.gauss(50, 20)) for _ in range(rng.randint(2, 14))]
    return minutes({"a": values}).withColumn("on", F.col("value") > 250).persist()


def test_predictor(spark, history, tmp_path):
    s = Series(slice="6 hours")
    names = list(features.PREDICTOR_FEATURES)
    data = features.predictor_labels(features.predictor_features(history, s, compressor="on"), s, compressor="on")
    assert {r[0] for r in data.select("label").distinct().collect()} == {0, 1}
    untrained = ml.predict_latest(None, data, s).first()
    assert (untrained.status, untrained.probability) == ("model_not_trained", 0.0)
    few = ml.train_forest(data.limit(100), names, "label")
    assert not few.success and "100/500" in few.error

    trained = ml.train_forest(data, names, "label", s, trees=10, depth=4, folds=3)
    assert trained.success and 0 <= trained.metrics["f1_mean"] <= 1
    assert sum(trained.importances.values()) == pytest.approx(1)
    got = ml.predict_latest(trained, data, s).first()
    assert got.status == "ok" and 0 <= got.probability <= 1
    ml.save_model(trained, f"{tmp_path}/m", spark)
    back = ml.load_model(spark, f"{tmp_path}/m")
    assert ml.predict_latest(back, data, s).first().probability == pytest.approx(got.probability)
    assert back.metrics == trained.metrics
    blank = data.withColumn("power_trend", F.lit(None).cast("double"))
    assert ml.predict_latest(trained, blank, s).first().status == "no_valid_features"


def test_folds_are_contiguous_and_stratified(spark, minutes):
    s = Series(slice="20 minutes")
    df = minutes({"a": [i % 3 == 0 for i in range(150)]}).withColumn("target", F.col("value").cast("int"))
    rows = features.time_folds(df, s, "target").orderBy("ts").collect()
    for label, size in ((1, 10), (0, 20)):
        folds = [r.fold for r in rows if r.target == label]
        assert folds == [i // size for i in range(5 * size)]


def test_too_little_history_gives_the_fixed_zones(minutes):
    got = analysis.learn_zones(minutes({"a": [100.0] * 50}), Series()).collect()
    assert sorted((r.kind, r.power_min, r.power_mean) for r in got if r.kind == "unstable") == [("unstable", 1000.0, None)]
    assert sorted(r.power_mean for r in got if r.kind == "stable") == [500.0, 1800.0]


def test_steady_series_is_stable(minutes):
    rng = random.Random(42)
    df = minutes({"a": [rng.gauss(500, 15) for _ in range(2880)], "short": [1.0] * 10})
    got = {r.entity_id: r for r in analysis.analyze_series(df, Series(slice="1 day")).collect()}
    assert got["a"].sufficient_data and 300 < got["a"].min_stable_power < 700
    assert got["a"].data_quality_score == 1.0
    assert all(r.stability_score > 0.6 for r in got["a"].regions)
    assert not got["short"].sufficient_data and got["short"].recommendation.startswith("Zu wenige Datenpunkte (10)")
    km = {r.entity_id: r for r in analysis.analyze_series(df, Series(slice="1 day"), method="kmeans", restarts=2).collect()}
    assert km["a"].min_stable_power < 700
