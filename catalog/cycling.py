"""Cycles, fluctuations, jumps and episodes."""

from pyspark.sql import functions as F

from catalog.registry import TELEMETRY, W, query, rounded
from wattloom.operators import cycling as ops

# 1 above on, 0 below off, otherwise the state holds
STATE = f"""st AS (SELECT *, coalesce(last_value(CASE WHEN value > 300 THEN 1 WHEN value < 150 THEN 0 END IGNORE NULLS)
    OVER ({W} ROWS UNBOUNDED PRECEDING), 0) AS state FROM telemetry)"""
CYCLES = f"""{STATE}, ch AS (SELECT *, coalesce(state - lag(state) OVER ({W}), 0) AS chg FROM st),
  ci AS (SELECT *, sum(CASE WHEN chg = 1 THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS cid FROM ch),
  cycles AS (SELECT entity_id, min(ts) AS start, max(ts) AS "end", (max(us) - min(us)) / 6e7::DOUBLE AS duration_minutes,
      max(value) AS peak_power, round(avg(value), 6) AS avg_power, count(*) AS rows
    FROM ci WHERE cid > 0 AND (state = 1 OR chg = -1) GROUP BY entity_id, cid HAVING max(CASE WHEN chg = -1 THEN 1 ELSE 0 END) = 1)"""

SCORES = f"""g AS (SELECT *, sign(coalesce(value - lag(value) OVER ({W}), 0)) AS sg FROM telemetry),
  dc AS (SELECT *, CASE WHEN sg <> lag(sg) OVER ({W}) THEN 1 ELSE 0 END AS turn FROM g),
  rl AS (SELECT *, avg(value) OVER w AS m, coalesce(stddev_samp(value) OVER w, 0) AS sd, max(value) OVER w - min(value) OVER w AS amp,
      avg(turn) OVER w AS f FROM dc WINDOW w AS ({W} RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW)),
  sc AS (SELECT *, CASE WHEN m = 0 AND (sd > 0 OR amp > 0) THEN 1.0::DOUBLE
      ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.4::DOUBLE * CASE WHEN m = 0 THEN 0 ELSE sd / m END
        + 0.4::DOUBLE * CASE WHEN m = 0 THEN 0 ELSE amp / m END + 2.0::DOUBLE * f)) END AS score FROM rl)"""

FLUCT = f"""{SCORES}, u1 AS (SELECT *, CASE WHEN score > 0.75 THEN 1 ELSE 0 END AS u FROM sc),
  u2 AS (SELECT *, coalesce(lag(u) OVER ({W}), 0) AS pu FROM u1),
  u3 AS (SELECT *, sum(CASE WHEN u = 1 AND pu = 0 THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS isl FROM u2),
  u4 AS (SELECT *, row_number() OVER (PARTITION BY entity_id, isl ORDER BY us) AS rn FROM u3 WHERE u = 1 OR pu = 1),
  u5 AS (SELECT *, CASE WHEN rn = 1 THEN 0 ELSE sg END AS s0 FROM u4),
  u6 AS (SELECT *, CASE WHEN s0 <> lag(s0) OVER (PARTITION BY entity_id, isl ORDER BY us) THEN 1 ELSE 0 END AS t0 FROM u5),
  fluct AS (SELECT entity_id, min(ts) AS start, max(ts) AS "end", (max(us) - min(us)) / 6e7::DOUBLE AS duration_minutes,
      round(avg(score), 6) AS instability_score, max(value) - min(value) AS amplitude_watts,
      CAST(sum(t0) AS BIGINT) AS direction_changes, round(avg(value), 6) AS avg_power, count(*) AS rows
    FROM u6 GROUP BY entity_id, isl HAVING count(*) >= 2)"""

JUMPS = f"""jumps AS (SELECT entity_id, ts, p AS power_before, value AS power_after, value - p AS delta_watts,
    round(CASE WHEN p > 0 THEN abs(value - p) / p * 100 END, 6) AS delta_pct
  FROM (SELECT *, lag(value) OVER ({W}) AS p FROM telemetry)
  WHERE abs(value - p) >= 300 OR (p > 0 AND abs(value - p) / p * 100 >= 40))"""


def cycles(t):
    return ops.detect_cycles(t.telemetry, t.S, on=300, off=150)


@query("hysteresis_state", f"WITH {TELEMETRY}, {STATE} SELECT entity_id, ts, value, state FROM st")
def _(t):
    return ops.hysteresis_state(t.telemetry, t.S, on=300, off=150)


@query("detect_cycles", f"WITH {TELEMETRY}, {CYCLES} SELECT * FROM cycles")
def _(t):
    return rounded(cycles(t), "avg_power")


@query("short_cycles", f"WITH {TELEMETRY}, {CYCLES} SELECT * FROM cycles WHERE duration_minutes < 60")
def _(t):
    return rounded(ops.short_cycles(cycles(t), 60), "avg_power")


@query("instability_score", f"WITH {TELEMETRY}, {SCORES} SELECT entity_id, ts, value, round(score, 6) AS score FROM sc")
def _(t):
    return rounded(ops.instability_score(t.telemetry, t.S, "2 hours"), "score")


@query(
    "detect_fluctuations",
    f"""WITH {TELEMETRY}, {FLUCT} SELECT *,
      round(direction_changes / CASE WHEN duration_minutes > 0 THEN duration_minutes ELSE 1 END, 6) AS frequency FROM fluct""",
)
def _(t):
    df = ops.detect_fluctuations(t.telemetry, t.S, "2 hours", threshold=0.75)
    return rounded(df, "instability_score", "avg_power", "frequency")


@query("detect_power_jumps", f"WITH {TELEMETRY}, {JUMPS} SELECT * FROM jumps")
def _(t):
    return rounded(ops.detect_power_jumps(t.telemetry, t.S), "delta_pct")


@query(
    "analyze_cycling",
    f"""WITH {TELEMETRY}, {CYCLES}, {FLUCT}, {JUMPS},
      sp AS (SELECT entity_id, (max(us) - min(us)) / 3600e6::DOUBLE AS time_span_hours FROM telemetry GROUP BY 1),
      c AS (SELECT entity_id, count(*) AS total_cycles, count(*) FILTER (duration_minutes < 60) AS short_cycle_count,
          avg(duration_minutes) AS avg_cycle_duration FROM cycles GROUP BY 1),
      i AS (SELECT entity_id, avg(score) AS avg_instability, max(score) AS max_instability FROM sc GROUP BY 1),
      f AS (SELECT entity_id, count(*) AS fluctuation_count FROM fluct GROUP BY 1),
      j AS (SELECT entity_id, count(*) AS jump_count FROM jumps GROUP BY 1)
    SELECT entity_id, coalesce(total_cycles, 0) AS total_cycles, coalesce(short_cycle_count, 0) AS short_cycle_count,
      round(avg_cycle_duration, 6) AS avg_cycle_duration, round(avg_instability, 6) AS avg_instability,
      round(max_instability, 6) AS max_instability, coalesce(fluctuation_count, 0) AS fluctuation_count,
      coalesce(jump_count, 0) AS jump_count, round(time_span_hours, 6) AS time_span_hours,
      round(CASE WHEN time_span_hours > 0 THEN coalesce(total_cycles, 0) / time_span_hours ELSE 0 END, 6) AS cycles_per_hour
    FROM sp LEFT JOIN c USING (entity_id) LEFT JOIN i USING (entity_id) LEFT JOIN f USING (entity_id) LEFT JOIN j USING (entity_id)""",
)
def _(t):
    df = ops.analyze_cycling(t.telemetry, t.S, 300, 150, width="2 hours", threshold=0.75, short_minutes=60)
    return rounded(df, "avg_cycle_duration", "avg_instability", "max_instability", "time_span_hours", "cycles_per_hour")


@query(
    "find_cycling_periods",
    f"""WITH {TELEMETRY}, {CYCLES}, b AS (SELECT entity_id, time_bucket(INTERVAL '6 hours', start, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n FROM cycles GROUP BY 1, 2),
      grid AS (SELECT entity_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL '6 hours')) AS bucket FROM b GROUP BY 1)
    SELECT entity_id, bucket, coalesce(n, 0) / 6.0::DOUBLE AS cycles_per_hour, coalesce(n, 0) / 6.0::DOUBLE > 0.5 AS is_problematic
    FROM grid LEFT JOIN b USING (entity_id, bucket)""",
)
def _(t):
    return ops.find_cycling_periods(cycles(t), t.S, "6 hours", per_hour=0.5)


_RISK = f"""rk AS (SELECT *, CASE WHEN sd > 250 THEN 30 ELSE 0 END + CASE WHEN sd > 500 THEN 30 ELSE 0 END
    + CASE WHEN spread > 1000 THEN 20 ELSE 0 END + CASE WHEN spread > 2000 THEN 20 ELSE 0 END AS risk FROM (
      SELECT *, stddev_samp(value) OVER w AS sd, max(value) OVER w - min(value) OVER w AS spread FROM telemetry
      WINDOW w AS ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)))"""


def _episodes(condition, min_rows):
    return f"""{_RISK}, fl AS (SELECT *, CASE WHEN {condition} THEN 1 ELSE 0 END AS hit FROM rk),
  ep AS (SELECT *, sum(1 - hit) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM fl),
  eps AS (SELECT entity_id, min(ts) AS start, max(ts) AS "end", min(value) AS power_min, max(value) AS power_max,
      round(avg(value), 6) AS power_mean, round(stddev_samp(value), 6) AS power_std, count(*) AS rows
    FROM ep WHERE hit = 1 GROUP BY entity_id, g HAVING count(*) > {min_rows})"""


@query("cycling_episodes", f"WITH {TELEMETRY}, {_episodes('risk > 70', 3)} SELECT * FROM eps")
def _(t):
    return rounded(ops.cycling_episodes(t.telemetry, t.S, min_rows=3, scale=5), "power_mean", "power_std")


@query(
    "stable_episodes",
    f"WITH {TELEMETRY}, {_episodes('risk < 30', 1)} SELECT *, power_mean < 250 AS low_power FROM eps",
)
def _(t):
    df = ops.stable_episodes(t.telemetry, t.S, min_rows=1, low_power=250, scale=5)
    return rounded(df, "power_mean", "power_std")


@query(
    "episode_summary",
    f"""WITH {TELEMETRY}, {_episodes('risk > 70', 3)} SELECT entity_id, count(*) AS episodes, round(avg(rows), 6) AS avg_rows,
      round(avg(power_max - power_min), 6) AS avg_spread, round(avg(power_mean), 4) AS avg_power, round(avg(power_std), 4) AS avg_std
    FROM eps GROUP BY 1""",
)
def _(t):
    eps = ops.cycling_episodes(t.telemetry, t.S, min_rows=3, scale=5)
    out = rounded(ops.episode_summary(eps, t.S.keys), "avg_rows", "avg_spread")
    return rounded(out, "avg_power", "avg_std", digits=4)


@query(
    "cycling_risk_additive",
    f"WITH {TELEMETRY}, {_RISK} SELECT entity_id, ts, risk AS cycling_risk, risk > 70 AS is_cycling, risk < 30 AS is_stable FROM rk",
)
def _(t):
    df = ops.with_additive_risk(t.telemetry, t.S, scale=5)
    return df.select(
        "entity_id",
        "ts",
        "cycling_risk",
        (F.col("cycling_risk") > 70).alias("is_cycling"),
        (F.col("cycling_risk") < 30).alias("is_stable"),
    )
