"""Statistics."""

from pyspark.sql import functions as F

from catalog.cycling import CYCLES, cycles
from catalog.registry import (
    BY_USER, CHANNEL_COLS, CHANNELS, READINGS, ROOM_STATE, TELEMETRY, channels, query, readings, room_state, rounded,
)
from catalog.scalars import STAB, stab
from wattloom.functions import scalar as fn
from wattloom.operators import stats as ops

Q = "quantile_cont"


@query(
    "power_stats",
    f"""WITH {BY_USER} SELECT entity_id, count(value) AS count, min(value) AS min, max(value) AS max, avg(value) AS mean, round(stddev_samp(value), 6) AS std,
      round({Q}(value, 0.25), 6) AS p25, round({Q}(value, 0.5), 6) AS median, round({Q}(value, 0.75), 6) AS p75 FROM telemetry GROUP BY 1""",
)
def _(t):
    return rounded(ops.power_stats(t.by_user, ("entity_id",)), "std", "p25", "median", "p75")


@query(
    "daily_load_stats",
    f"""WITH d AS (SELECT l_suppkey, l_shipdate, sum(l_quantity) AS load FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, count(load) AS count, min(load) AS min, max(load) AS max, avg(load) AS mean, round(stddev_samp(load), 6) AS std,
      round({Q}(load, 0.25), 6) AS p25, round({Q}(load, 0.5), 6) AS median, round({Q}(load, 0.75), 6) AS p75 FROM d GROUP BY 1""",
)
def _(t):
    load = t.table("lineitem").groupBy("l_suppkey", "l_shipdate").agg(F.sum("l_quantity").alias("load"))
    return rounded(ops.power_stats(load, ("l_suppkey",), "load"), "std", "p25", "median", "p75")


@query(
    "describe_transitions",
    f"""WITH {CHANNELS}, l AS (UNPIVOT channels ON {', '.join(CHANNEL_COLS)} INTO NAME "column" VALUE value)
    SELECT "column", count(value) AS count, min(value) AS min, max(value) AS max, avg(value) AS mean, round(stddev_samp(value), 6) AS std,
      round({Q}(value, 0.25), 6) AS p25, round({Q}(value, 0.5), 6) AS median, round({Q}(value, 0.75), 6) AS p75 FROM l GROUP BY 1""".replace(
        "avg(value) AS mean", "round(avg(value), 6) AS mean"
    ),
)
def _(t):
    return rounded(ops.describe_transitions(channels(t), CHANNEL_COLS), "mean", "std", "p25", "median", "p75")


@query(
    "stability_shares",
    f"""WITH {TELEMETRY}, {STAB} SELECT entity_id, round(avg(CASE WHEN std < 250 THEN 1 ELSE 0 END) * 100, 6) AS stable_pct,
      round(avg(CASE WHEN std < 250 AND value < 600 THEN 1 ELSE 0 END) * 100, 6) AS low_power_stable_pct,
      round(avg(CASE WHEN std > 500 OR spread > 2000 THEN 1 ELSE 0 END) * 100, 6) AS cycling_pct, round(avg(std), 6) AS mean_std FROM stab GROUP BY 1""",
)
def _(t):
    df = ops.stability_shares(stab(t), ("entity_id",), stable=250, cycling_std=500, cycling_spread=2000)
    return rounded(df, "stable_pct", "low_power_stable_pct", "cycling_pct", "mean_std")


@query(
    "quantile_threshold",
    f"""WITH {TELEMETRY}, {STAB}, r AS (SELECT * FROM stab WHERE value > 100), q AS (SELECT entity_id, {Q}(std, 0.25) AS th FROM r GROUP BY 1)
    SELECT entity_id, ts, round(th, 6) AS threshold, coalesce(std < th, false) AS stable_quantile FROM r JOIN q USING (entity_id)""",
)
def _(t):
    df = ops.quantile_threshold(stab(t).filter("value > 100"), ("entity_id",))
    return rounded(df, "threshold").select("entity_id", "ts", "threshold", "stable_quantile")


_BAND = "CASE " + " ".join(f"WHEN value >= {a} AND value < {b} THEN '{a}-{b}'" for a, b in fn.ADAPTIVE_BANDS) + " END"


@query(
    "adaptive_thresholds",
    f"""WITH {TELEMETRY}, {STAB}, b AS (SELECT *, {_BAND} AS band FROM stab WHERE std IS NOT NULL),
      q AS (SELECT entity_id, band, {Q}(std, 0.25) AS th FROM b WHERE band IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 100)
    SELECT entity_id, band, round(th, 6) AS threshold, count(*) AS rows, count(*) FILTER (std < th) AS stable_rows,
      round(count(*) FILTER (std < th) / count(*)::DOUBLE * 100, 6) AS stable_pct FROM b JOIN q USING (entity_id, band) GROUP BY 1, 2, th""",
)
def _(t):
    df = stab(t).filter("power_std is not null").withColumn("band", fn.power_band_left("value", fn.ADAPTIVE_BANDS))
    return rounded(ops.adaptive_thresholds(df, ("entity_id",)), "threshold", "stable_pct")


@query(
    "band_distribution",
    "WITH "
    + TELEMETRY
    + ", "
    + STAB
    + ", s AS (SELECT * FROM stab WHERE std < 350), bands AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}-{b}', {a}, {b})" for a, b in fn.DISTRIBUTION_BANDS)
    + """) v(band, lo, hi))
    SELECT e.entity_id, band, count(s.value) FILTER (s.value >= lo AND s.value < hi) AS rows,
      round(count(s.value) FILTER (s.value >= lo AND s.value < hi) / count(*)::DOUBLE * 100, 6) AS pct
    FROM (SELECT DISTINCT entity_id FROM s) e, bands JOIN s ON s.entity_id = e.entity_id GROUP BY 1, 2""",
)
def _(t):
    return rounded(ops.band_distribution(stab(t).filter("power_std < 350"), ("entity_id",)), "pct")


_OTHERS = CHANNEL_COLS[1:]


@query(
    "corr_with_target",
    f"WITH {CHANNELS}, r AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr(power, {c}) AS r FROM channels" for c in _OTHERS)
    + """) SELECT feature, round(r, 6) AS r, CASE WHEN r > 0.01 THEN 'up' WHEN r < -0.01 THEN 'down' ELSE '' END AS strength
    FROM r WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY abs(r) DESC LIMIT 3""",
)
def _(t):
    return rounded(ops.corr_with_target(channels(t), "power", _OTHERS, top=3, strong=0.01), "r")


@query(
    "corr_matrix",
    f"WITH {CHANNELS} "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM channels" for a in CHANNEL_COLS for b in CHANNEL_COLS),
)
def _(t):
    return rounded(ops.corr_matrix(channels(t), CHANNEL_COLS), "r")


@query(
    "mode_value",
    f"""WITH {READINGS}, c AS (SELECT entity_id, event_type, count(*) AS rows FROM readings GROUP BY 1, 2)
    SELECT entity_id, event_type, rows FROM c QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY rows DESC, event_type) = 1""",
)
def _(t):
    return ops.mode_value(readings(t), ("entity_id",), "event_type")


@query("value_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def _(t):
    return ops.value_counts(t.events, "event_type")


@query(
    "histogram",
    f"""WITH {TELEMETRY}, s AS (SELECT entity_id, min(value) AS lo, max(value) AS hi FROM telemetry GROUP BY 1),
      b AS (SELECT entity_id, least(CAST(floor((value - lo) / (hi - lo) * 30) AS BIGINT), 29) AS bin, count(*) AS rows FROM telemetry JOIN s USING (entity_id) GROUP BY 1, 2)
    SELECT entity_id, bin, round(lo + bin * ((hi - lo) / 30), 6) AS left_edge, coalesce(rows, 0) AS rows
    FROM (SELECT *, unnest(range(30)) AS bin FROM s) LEFT JOIN b USING (entity_id, bin)""",
)
def _(t):
    return rounded(ops.histogram(t.telemetry, ("entity_id",), "value", 30), "left_edge")


@query("hour_distribution", "SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS rows FROM events GROUP BY 1, 2")
def _(t):
    return ops.hour_distribution(t.events, "ts", ("event_type",))


@query(
    "cluster_stats",
    f"""WITH {TELEMETRY}, {STAB}, c AS (SELECT *, CAST(floor(value / 500) AS INTEGER) AS cluster FROM stab)
    SELECT cluster, count(*) AS size, avg(value) AS power_mean, round(avg(std), 6) AS power_std_mean, round({Q}(value, 0.5), 6) AS power_median,
      round({Q}(std, 0.5), 6) AS power_std_median FROM c GROUP BY 1""",
)
def _(t):
    df = stab(t).withColumn("cluster", F.floor(F.col("value") / 500).cast("int"))
    return rounded(ops.cluster_stats(df, power="value", outdoor=None), "power_std_mean", "power_median", "power_std_median")


@query(
    "transition_change_counts",
    f"""WITH {CHANNELS}, d AS (SELECT outdoor_temp - lag(outdoor_temp) OVER w AS outdoor_delta, target_eg - lag(target_eg) OVER w AS target_delta
      FROM channels WINDOW w AS (PARTITION BY site_id ORDER BY us)), l AS (SELECT 'outdoor_delta' AS channel, outdoor_delta AS delta FROM d UNION ALL SELECT 'target_delta', target_delta FROM d)
    SELECT channel, round(avg(delta), 6) AS mean_delta, count(*) FILTER (abs(delta) > 0.1) AS changes, count(*) AS transitions FROM l GROUP BY 1""",
)
def _(t):
    from wattloom.operators.windows import diff_n

    df = diff_n(channels(t), t.SITE.of("outdoor_temp"), 1, "outdoor_delta")
    df = diff_n(df, t.SITE.of("target_eg"), 1, "target_delta")
    return rounded(ops.transition_change_counts(df, ["outdoor_delta", "target_delta"]), "mean_delta")


@query(
    "total_power",
    f"""WITH {READINGS}, l AS (SELECT site_id, entity_id, CASE WHEN arg_max(k, us) < 25 THEN 'unavailable' ELSE CAST(floor(arg_max(value, us) * 10) AS VARCHAR) END AS state FROM readings GROUP BY 1, 2)
    SELECT site_id, count(*) AS units, CASE WHEN count(*) = 1 THEN sum(TRY_CAST(state AS DOUBLE)) ELSE coalesce(sum(TRY_CAST(state AS DOUBLE)), 0) END AS total_power FROM l GROUP BY 1""",
)
def _(t):
    k = F.col("k")
    state = F.when(k < 25, "unavailable").otherwise(F.floor(F.col("value") * 10).cast("string")).alias("state")
    r = readings(t).select("site_id", F.col("entity_id").alias("unit_id"), "ts", state)
    return ops.total_power(r, r.select("site_id", "unit_id").distinct())


@query(
    "comfort_emergency",
    f"""WITH {ROOM_STATE} SELECT site_id, cycle, bool_or(delta < -1.5 OR delta > 1.0) AS comfort_emergency,
      coalesce(string_agg(CASE WHEN delta < -1.5 OR delta > 1.0 THEN room END, ',' ORDER BY room), '') AS offending_rooms FROM rooms_on GROUP BY 1, 2""",
)
def _(t):
    return ops.comfort_emergency(room_state(t), ("site_id", "cycle"))


EMERGENCY_WINDOWS = """m AS (SELECT entity_id, time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS bucket, avg(value) AS value FROM telemetry GROUP BY 1, 2),
      f AS (SELECT *, count(*) OVER w AS points, stddev_samp(value) OVER w AS sd, max(value) OVER w - min(value) OVER w AS rg FROM m
        WINDOW w AS (PARTITION BY entity_id ORDER BY epoch_us(bucket) RANGE BETWEEN 10800000000 PRECEDING AND CURRENT ROW))"""
EMERGENCY_ROWS = """SELECT entity_id, bucket, value, points, round(sd, 6) AS power_std, rg AS power_range, points >= 5 AND (sd > 300 OR rg > 800) AS stability_emergency FROM f"""


@query("stability_emergency", f"WITH {TELEMETRY}, {EMERGENCY_WINDOWS} {EMERGENCY_ROWS}")
def _(t):
    return rounded(ops.stability_emergency(t.telemetry, t.S, "10 minutes", "3 hours"), "power_std")


@query(
    "data_sufficiency",
    f"""WITH {BY_USER}, s AS (SELECT entity_id, count(*) AS rows, (max(us) - min(us)) / 3600e6::DOUBLE AS hours FROM telemetry GROUP BY 1)
    SELECT entity_id, rows, hours, rows >= 60 AND hours >= 700 AS sufficient, CASE WHEN rows < 60 THEN format('Zu wenige Datenpunkte ({{}}). Benötigt mindestens 60.', rows)
      WHEN hours < 700 THEN format('Zu kurzer Zeitraum ({{:.1f}}h). Benötigt mindestens 700h.', hours) ELSE format('Ausreichend: {{}} Punkte über {{:.1f}}h', rows, hours) END AS message FROM s""",
)
def _(t):
    return ops.data_sufficiency(t.by_user, t.S, min_rows=60, min_hours=700)


@query(
    "data_quality",
    f"""WITH {BY_USER} SELECT entity_id, greatest(0.0::DOUBLE, round(1 - (1 - count(v) / count(*)::DOUBLE) * 0.5::DOUBLE
      - CASE WHEN stddev_samp(v) < 5 THEN 0.4::DOUBLE ELSE 0 END, 6)) AS data_quality_score
    FROM (SELECT entity_id, CASE WHEN value > 300 THEN value END AS v FROM telemetry) GROUP BY 1""",
)
def _(t):
    df = t.by_user.withColumn("value", F.expr("case when value > 300 then value end"))
    return rounded(ops.data_quality(df, t.S), "data_quality_score")


@query(
    "class_balance",
    f"""WITH {TELEMETRY}, {STAB}, l AS (SELECT entity_id, CASE WHEN std > 500 THEN 1 ELSE 0 END AS target FROM stab WHERE std < 250 OR std > 500)
    SELECT entity_id, count(*) AS rows, count(*) FILTER (target = 0) AS negatives, count(*) FILTER (target = 1) AS positives, round(avg(target), 6) AS positive_rate FROM l GROUP BY 1""",
)
def _(t):
    from wattloom.operators.features import label_binary

    return rounded(ops.class_balance(label_binary(stab(t), "power_std", 250, 500), keys=("entity_id",)), "positive_rate")


@query(
    "critical_room",
    f"""WITH {ROOM_STATE} SELECT site_id, cycle, room AS critical_room, delta FROM rooms_on QUALIFY row_number() OVER (PARTITION BY site_id, cycle ORDER BY abs(delta) DESC, room) = 1""",
)
def _(t):
    return ops.critical_room(room_state(t), ("site_id", "cycle"))


@query(
    "kpi_rollup",
    f"""WITH {TELEMETRY}, {STAB}, {CYCLES},
      p AS (SELECT entity_id, CAST(ts AS DATE) AS date, avg(CASE WHEN std < 350 THEN 1 ELSE 0 END) * 100 AS stable_pct,
        CASE WHEN count(*) FILTER (std < 350) > 0 THEN count(*) FILTER (std < 350 AND value < 600) / (count(*) FILTER (std < 350))::DOUBLE * 100 END AS low FROM stab GROUP BY 1, 2),
      c AS (SELECT entity_id, CAST(start AS DATE) AS date, count(*) AS cycles, avg(duration_minutes) AS avg_cycle_minutes FROM cycles GROUP BY 1, 2),
      d AS (SELECT event_type AS entity_id, CAST(ts AS DATE) AS date, sqrt(avg((floor(value) / 16.0::DOUBLE - 3) * (floor(value) / 16.0::DOUBLE - 3))) AS rms FROM events GROUP BY 1, 2),
      a AS (SELECT event_type AS entity_id, CAST(ts AS DATE) AS date, count(*) AS actions FROM events WHERE value > 150 GROUP BY 1, 2)
    SELECT entity_id, date, round(stable_pct, 6) AS stable_pct, round(low, 6) AS low_power_share_pct, coalesce(cycles, 0) AS cycles, round(avg_cycle_minutes, 6) AS avg_cycle_minutes,
      round(rms, 6) AS rms_deviation, coalesce(actions, 0) AS actions FROM p FULL JOIN c USING (entity_id, date) FULL JOIN d USING (entity_id, date) FULL JOIN a USING (entity_id, date)""",
)
def _(t):
    typed = t.events.withColumnRenamed("event_type", "entity_id")
    deviations = typed.select("entity_id", "ts", (F.floor("value") / 16.0 - 3).alias("delta"))
    df = ops.kpi_rollup(stab(t), cycles(t), deviations, typed.filter("value > 150").select("entity_id", "ts"), ("entity_id",), stable=350)
    return rounded(df, "stable_pct", "low_power_share_pct", "avg_cycle_minutes", "rms_deviation")


_PRED = """pr AS (SELECT CASE WHEN value > 60 THEN 1 ELSE 0 END AS label, CASE WHEN regexp_extract(props, '"k": ([0-9]+)', 1)::INTEGER > 45 THEN 1 ELSE 0 END AS prediction FROM events)"""


def predicted(t):
    return readings(t).select((F.col("value") > 60).cast("int").alias("label"), (F.col("k") > 45).cast("int").alias("prediction"))


@query(
    "confusion_matrix",
    f"WITH {_PRED} SELECT label AS actual, prediction AS predicted, count(*) AS rows FROM pr GROUP BY 1, 2",
)
def _(t):
    return ops.confusion_matrix(predicted(t))


@query(
    "classification_report",
    f"""WITH {_PRED}, c AS (SELECT c, count(*) FILTER (label = c AND prediction = c)::DOUBLE AS tp, count(*) FILTER (prediction = c) AS pp, count(*) FILTER (label = c) AS sp
        FROM pr, (VALUES (0), (1)) v(c) GROUP BY 1),
      m AS (SELECT c, tp / pp AS p, tp / sp AS r, 2 * (tp / pp) * (tp / sp) / (tp / pp + tp / sp) AS f, sp FROM c), n AS (SELECT count(*) AS n, avg(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS a FROM pr)
    SELECT CAST(c AS VARCHAR) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, sp AS support FROM m
    UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), n FROM n
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(sp) AS BIGINT) FROM m
    UNION ALL SELECT 'weighted avg', round(sum(p * sp) / sum(sp), 6), round(sum(r * sp) / sum(sp), 6), round(sum(f * sp) / sum(sp), 6), CAST(sum(sp) AS BIGINT) FROM m""",
)
def _(t):
    return rounded(ops.classification_report(predicted(t)), "precision", "recall", "f1")
