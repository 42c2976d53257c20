"""Features, labels, sampling and models."""

from pyspark.sql import functions as F

from catalog.registry import CHANNELS, TELEMETRY, W, channels, query, rounded
from catalog.scans import scratch
from catalog.scalars import STAB, stab
from wattloom.operators import features as ops
from wattloom.operators import ml
from wattloom.operators import stats
from wattloom.operators.windows import ffill
from wattloom.sources import sinks

ROOMS = {"eg": ("temp_eg", "target_eg")}
_SW = "PARTITION BY site_id ORDER BY us"

_PF = f"""x AS (SELECT *, CASE WHEN value > 300 THEN 1 ELSE 0 END AS on_, sum(CASE WHEN value > 300 THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM telemetry),
  pf AS (SELECT entity_id, ts, us, value AS power, avg(value) OVER w AS power_trend, coalesce(stddev_samp(value) OVER w, 0) AS power_std, CAST(hour(ts) AS INTEGER) AS hour,
      coalesce(value - lag(value) OVER ({W}), 0) AS power_diff, abs(coalesce(value - lag(value) OVER ({W}), 0)) AS power_diff_abs,
      CAST(sum(on_) OVER (PARTITION BY entity_id, g ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS compressor_runtime, on_
    FROM x WINDOW w AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


def on_frame(t):
    return t.telemetry.withColumn("compressor_on", F.col("value") > 300)


def predictor_frame(t):
    df = ops.predictor_features(on_frame(t), t.S, compressor="compressor_on")
    return ops.predictor_labels(df, t.S, compressor="compressor_on", per_hour=30)


@query(
    "predictor_features",
    f"""WITH {TELEMETRY}, {_PF} SELECT entity_id, ts, power, round(power_trend, 6) AS power_trend, round(power_std, 6) AS power_std, hour, power_diff, power_diff_abs,
      compressor_runtime, 0.0::DOUBLE AS outdoor_temp, 0 AS active_units FROM pf""",
)
def _(t):
    df = ops.predictor_features(on_frame(t), t.S, compressor="compressor_on")
    return rounded(df, "power_trend", "power_std").select("entity_id", "ts", *ops.PREDICTOR_FEATURES)


@query(
    "predictor_labels",
    f"""WITH {TELEMETRY}, {_PF}, m AS (SELECT *, coalesce(abs(on_ - lag(on_) OVER ({W})), 0) AS moved FROM pf)
    SELECT entity_id, ts, CASE WHEN sum(moved) OVER ({W} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) >= 5 THEN 1 ELSE 0 END AS label FROM m""",
)
def _(t):
    return ops.predictor_labels(on_frame(t), t.S, compressor="compressor_on", per_hour=30).select("entity_id", "ts", "label")


def filled(t):
    return ffill(channels(t), t.SITE, ["target_eg"])


_FILLED = f"""{CHANNELS}, f AS (SELECT * REPLACE (last_value(target_eg IGNORE NULLS) OVER ({_SW} ROWS UNBOUNDED PRECEDING) AS target_eg) FROM channels)"""
_W6 = f"WINDOW w AS ({_SW} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
_CAUSAL = f"""{_FILLED}, ca AS (SELECT site_id, ts, us, power, stddev_samp(power) OVER w AS power_std, max(power) OVER w - min(power) OVER w AS power_spread, power AS power_level, outdoor_temp AS outdoor_temp_norm,
      outdoor_temp - lag(outdoor_temp, 6) OVER ({_SW}) AS outdoor_temp_change, temp_eg - target_eg AS delta_eg, abs(temp_eg - target_eg) AS delta_eg_abs,
      coalesce(abs(temp_eg - target_eg), 0) AS total_delta_abs, CASE WHEN abs(target_eg - lag(target_eg) OVER ({_SW})) > 0.1 THEN 1 ELSE 0 END AS any_target_changed,
      sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM f {_W6})"""
CAUSAL = ops.causal_feature_names(ROOMS)


# not rounded: integers, and plain differences of readings
exact = ("any_target_changed", "is_weekend", "power", "power_level", "outdoor_temp", "outdoor_temp_norm", "outdoor_temp_change", "delta_eg", "delta_eg_abs", "total_delta_abs")


def _r6(names):
    return ", ".join(c if c in exact else f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in names)


def _rounded6(df, names):
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in names if c not in exact})


@query("causal_features", f"WITH {_CAUSAL} SELECT site_id, ts, {_r6(CAUSAL)} FROM ca")
def _(t):
    return _rounded6(ops.causal_features(filled(t), t.SITE, ROOMS), CAUSAL).select("site_id", "ts", *CAUSAL)


SYMPTOM = ops.symptom_feature_names(ROOMS)
_SYM = f"""{_FILLED}, sd AS (SELECT *, power - lag(power) OVER ({_SW}) AS dp, outdoor_temp - lag(outdoor_temp) OVER ({_SW}) AS dout FROM f),
  sy AS (SELECT site_id, ts, us, power, stddev_samp(power) OVER w AS power_std, CASE WHEN count(dp) OVER w = 6 THEN avg(dp) OVER w END AS power_gradient, max(power) OVER w - min(power) OVER w AS power_spread,
      outdoor_temp, CASE WHEN count(dout) OVER w = 6 THEN avg(dout) OVER w END AS outdoor_gradient, temp_eg - target_eg AS delta_eg, abs(temp_eg - target_eg) AS delta_eg_abs,
      sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos FROM sd {_W6})"""


def symptom(t):
    return ops.symptom_features(filled(t), t.SITE, ROOMS)


@query("symptom_features", f"WITH {_SYM} SELECT site_id, ts, {_r6(SYMPTOM)} FROM sy")
def _(t):
    return _rounded6(symptom(t), SYMPTOM).select("site_id", "ts", *SYMPTOM)


def _imputed(c):
    if "gradient" in c:
        return f"coalesce({c}, 0) AS {c}"
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER ({_SW} ROWS UNBOUNDED PRECEDING),
        first_value({c} IGNORE NULLS) OVER ({_SW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"""


_LABELLED = f"""{_SYM}, lb AS (SELECT *, CASE WHEN power_std > 300 THEN 1 ELSE 0 END AS target FROM sy WHERE power_std < 250 OR power_std > 300),
  im0 AS (SELECT site_id, ts, target, {', '.join(_imputed(c) for c in SYMPTOM)} FROM lb),
  im AS (SELECT * FROM im0 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SYMPTOM)})"""


def imputed(t):
    labelled = ops.label_binary(symptom(t), "power_std", 250, 300)
    return ops.impute_features(labelled, t.SITE, SYMPTOM)


@query("impute_features", f"WITH {_LABELLED} SELECT site_id, ts, target, {_r6(SYMPTOM)} FROM im")
def _(t):
    return _rounded6(imputed(t), SYMPTOM).select("site_id", "ts", "target", *SYMPTOM)


_STB = f"""tg AS (SELECT entity_id, ts, us, value, std, CASE WHEN std > 500 THEN 1 ELSE 0 END AS target FROM stab WHERE std < 250 OR std > 500),
  rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('42|' || entity_id || '|' || us)) AS r, count(*) OVER (PARTITION BY target) AS n FROM tg)"""


def targets(t):
    return ops.label_binary(stab(t), "power_std", 250, 500).withColumn("us", F.unix_micros("ts"))


@query("stratified_split", f"WITH {TELEMETRY}, {STAB}, {_STB} SELECT entity_id, ts, target, r <= floor(n * 0.7::DOUBLE + 1e-9) AS is_train FROM rk")
def _(t):
    return ops.stratified_split(targets(t), ["entity_id", "us"]).select("entity_id", "ts", "target", "is_train")


@query("balance_classes")
def _(t):
    return ops.balance_classes(targets(t), ["entity_id", "us"]).select("entity_id", "ts", "target")


@query(
    "balance_classes_down",
    f"WITH {TELEMETRY}, {STAB}, {_STB} SELECT entity_id, ts, target FROM rk WHERE r <= (SELECT min(n) FROM rk)",
)
def _(t):
    return ops.balance_classes(targets(t), ["entity_id", "us"], replacement=False).select("entity_id", "ts", "target")


@query(
    "time_folds",
    f"""WITH {TELEMETRY}, {STAB}, {_STB} SELECT entity_id, ts, target, CAST(floor((row_number() OVER (PARTITION BY target ORDER BY us, entity_id) - 1) * 5 / n) AS INTEGER) AS fold FROM rk""",
)
def _(t):
    return ops.time_folds(targets(t), t.S, "target").select("entity_id", "ts", "target", "fold")


def small_forest(t, **options):
    return ml.train_forest(predictor_frame(t), list(ops.PREDICTOR_FEATURES), "label", trees=20, depth=5, **options)


@query("train_forest")
def _(t):
    # reported on rows that the forest was not trained on
    rows = predictor_frame(t).withColumn("us", F.unix_micros("ts"))
    rows = ops.stratified_split(rows, ["entity_id", "us"], "label")
    trained = ml.train_forest(rows.filter("is_train"), list(ops.PREDICTOR_FEATURES), "label")
    return stats.classification_report(ml.score(trained.model, rows.filter("NOT is_train")))


@query("cross_validate_f1")
def _(t):
    m = ml.cross_validate_f1(predictor_frame(t), list(ops.PREDICTOR_FEATURES), "label", t.S, trees=10, depth=4)
    return t.spark.createDataFrame([(m["f1_mean"], m["f1_std"])], "f1_mean double, f1_std double")


@query("predict_latest")
def _(t):
    return ml.predict_latest(small_forest(t), predictor_frame(t), t.S)


@query("save_model")
def _(t):
    path = scratch(t, "model")
    ml.save_model(small_forest(t), path, t.spark)
    return ml.predict_latest(ml.load_model(t.spark, path), predictor_frame(t), t.S)


@query("load_model")
def _(t):
    path = scratch(t, "model")
    ml.save_model(small_forest(t), path, t.spark)
    return ml.feature_importance(t.spark, ml.load_model(t.spark, path))


@query("feature_importance")
def _(t):
    return ml.feature_importance(t.spark, small_forest(t), top=10)


@query("write_feature_importance")
def _(t):
    data = ops.balance_classes(imputed(t), ["site_id", "ts"])
    split = ops.stratified_split(imputed(t), ["site_id", "ts"]).filter("is_train")
    trained = ml.train_forest(data.unionByName(split.select(*data.columns)), SYMPTOM, trees=20, depth=5, min_rows=1, balanced=False)
    path = scratch(t, "importance")
    sinks.write_feature_importance(ml.feature_importance(t.spark, trained), path)
    return t.spark.read.schema("feature string, importance double").option("header", True).csv(path)
