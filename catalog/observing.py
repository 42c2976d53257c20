"""Observer risk and reports."""

from pyspark.sql import functions as F

from catalog.registry import READINGS, TELEMETRY, W, query, readings, rounded
from wattloom.operators import observer as ops

# windows are scaled to the readings at hand: steps beyond 1500 W, scores divided by 8
OBS = f"""d AS (SELECT *, abs(value - lag(value) OVER ({W})) AS dl, row_number() OVER ({W}) AS rn FROM telemetry),
  o AS (SELECT *, stddev_pop(value) OVER w AS sd, max(value) OVER w - min(value) OVER w AS sp,
      sum(CASE WHEN dl > 200 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS jm FROM d
    WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  obs AS (SELECT entity_id, ts, us, value, dl, rn, CASE WHEN rn < 5 THEN 0.0::DOUBLE ELSE
      least(1.0::DOUBLE, 0.4::DOUBLE * (sd / 125) + 0.4::DOUBLE * (sp / 1000) + 0.2::DOUBLE * (jm / 10.0::DOUBLE)) END AS score FROM o)"""


def small(t):
    """Readings of a tenth of the size, so that scores spread over the whole range."""
    return t.telemetry.withColumn("value", F.floor(F.col("value") / 10).cast("double"))


SMALL = TELEMETRY.replace("floor(value * 10) AS value", "floor(floor(value * 10) / 10) AS value")


@query(
    "observer_risk",
    f"WITH {SMALL}, {OBS} SELECT entity_id, ts, value, round(score, 6) AS instability_score, score > 0.6 AS is_cycling FROM obs",
)
def _(t):
    return rounded(ops.observer_risk(small(t), t.S).drop("cycling_risk"), "instability_score")


@query(
    "recent_jumps",
    f"""WITH {TELEMETRY}, {OBS} SELECT entity_id, ts, dl AS delta, row_number() OVER (PARTITION BY entity_id ORDER BY us DESC) AS recency
    FROM obs WHERE rn >= 5 AND dl > 200 QUALIFY recency <= 10""",
)
def _(t):
    return ops.recent_jumps(t.telemetry, t.S)


@query(
    "window_instability",
    f"""WITH {TELEMETRY}, b AS (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS bucket FROM telemetry),
      r AS (SELECT *, stddev_samp(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS sd, abs(value - lag(value) OVER w) > 800 AS jump FROM b
        WINDOW w AS (PARTITION BY entity_id, bucket ORDER BY us)),
      g AS (SELECT entity_id, bucket, count(*) AS rows, count(*) FILTER (jump) AS jumps, avg(value) AS m, avg(sd) AS sd, max(value) - min(value) AS sw FROM r GROUP BY 1, 2)
    SELECT entity_id, bucket, rows, jumps, CASE WHEN rows < 3 OR m < 1 THEN 0 ELSE round(0.4::DOUBLE * least(1, sd / m) + 0.35::DOUBLE * least(1, jumps / 6.0::DOUBLE)
      + 0.25::DOUBLE * least(1, sw / m), 6) END AS score FROM g""",
)
def _(t):
    return rounded(ops.window_instability(t.telemetry, t.S, "6 hours", jump=800), "score")


@query(
    "status_summary",
    f"""WITH {SMALL}, {OBS}, n AS (SELECT entity_id, max(ts) AS ts, arg_max(value, us) AS power, arg_max(score, us) AS score FROM obs GROUP BY 1),
      j AS (SELECT entity_id, least(count(*), 10) AS recent_jumps FROM obs WHERE rn >= 5 AND dl > 200 GROUP BY 1),
      {READINGS}, u AS (SELECT event_type AS entity_id, user_id, arg_max(k, us) >= 30 AS is_on FROM readings GROUP BY 1, 2),
      a AS (SELECT entity_id, count(*) FILTER (is_on) AS active_units FROM u GROUP BY 1)
    SELECT entity_id, ts, power, round(score, 3) AS instability_score, score > 0.6 AS is_cycling, coalesce(recent_jumps, 0) AS recent_jumps, coalesce(active_units, 0) AS active_units
    FROM n LEFT JOIN j USING (entity_id) LEFT JOIN a USING (entity_id)""",
)
def _(t):
    r = readings(t).groupBy(F.col("event_type").alias("entity_id"), "user_id").agg((F.max_by("k", "ts") >= 30).alias("is_on"))
    return ops.status_summary(ops.observer_risk(small(t), t.S), ops.recent_jumps(small(t), t.S), r, t.S).drop("cycling_risk")


@query(
    "risk_bands",
    f"""WITH {SMALL}, {OBS} SELECT entity_id, round(avg(CASE WHEN score > 0.7 THEN 1 ELSE 0 END) * 100, 6) AS high_pct,
      round(avg(CASE WHEN score > 0.5 AND score <= 0.7 THEN 1 ELSE 0 END) * 100, 6) AS medium_pct, round(avg(CASE WHEN score <= 0.5 THEN 1 ELSE 0 END) * 100, 6) AS low_pct,
      round(avg(score), 6) AS mean_risk, round(max(score), 6) AS max_risk FROM obs GROUP BY 1""",
)
def _(t):
    df = ops.risk_bands(ops.observer_risk(small(t), t.S), ("entity_id",), "instability_score")
    return rounded(df, "high_pct", "medium_pct", "low_pct", "mean_risk", "max_risk")


@query(
    "validation_report",
    f"""WITH {SMALL}, {OBS}, s AS (SELECT *, stddev_samp(value) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS std FROM obs),
      m AS (SELECT entity_id, min(value) AS v1, round(avg(CASE WHEN score > 0.7 THEN 1 ELSE 0 END) * 100, 6) AS v2, count(*) FILTER (score > 0.6)::DOUBLE AS v3,
        round(avg(CASE WHEN std < 50 THEN 1 ELSE 0 END) * 100, 6) AS v4, round(avg(CASE WHEN std < 50 AND value < 60 THEN 1 ELSE 0 END) * 100, 6) AS v5 FROM s GROUP BY 1),
      c AS (SELECT entity_id, 'Analyzer identifies low-power zones (<700W)' AS "check", v1 AS value, v1 < 700 AS passed FROM m
        UNION ALL SELECT entity_id, 'Observer detects cycling events', v2, v2 > 0 FROM m UNION ALL SELECT entity_id, 'Controller makes decisions', v3, v3 > 0 FROM m
        UNION ALL SELECT entity_id, 'Stable time >= 40%', v4, v4 >= 40 FROM m UNION ALL SELECT entity_id, 'Low-power stable >= 20%', v5, v5 >= 20 FROM m)
    SELECT *, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id) AS INTEGER) AS passed_count FROM c""",
)
def _(t):
    from wattloom.operators.stats import with_stability

    seen = with_stability(ops.observer_risk(small(t), t.S), t.S)
    score, calm = F.col("instability_score"), F.coalesce(F.col("power_std") < 50, F.lit(False))
    metrics = seen.groupBy("entity_id").agg(
        F.min("value").alias("min_stable_power"),
        F.round(F.avg((score > 0.7).cast("int")) * 100, 6).alias("high_risk_pct"),
        F.count_if(score > 0.6).alias("actions"),
        F.round(F.avg(calm.cast("int")) * 100, 6).alias("stable_pct"),
        F.round(F.avg((calm & (F.col("value") < 60)).cast("int")) * 100, 6).alias("low_power_stable_pct"),
    )
    return ops.validation_report(metrics, ("entity_id",))
