"""Alignment, as-of and range joins."""

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from catalog.registry import (
    READINGS, ROOMS, TELEMETRY, UNITS, W, query, readings, rooms, rounded, units,
)
from catalog.window_ops import PHASED, phased
from wattloom.operators import joins as ops
from wattloom.operators import stats
from wattloom.operators.cycling import hysteresis_state
from wattloom.operators.windows import lag_phase

UTC = dt.timezone.utc
BUCKET = "time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01')"


@query(
    "outer_align_join",
    f"""WITH {READINGS},
      s AS (SELECT site_id, {BUCKET} AS ts, avg(floor(value * 10)) AS power FROM readings WHERE event_type = 'click' GROUP BY ALL),
      c AS (SELECT site_id, {BUCKET} AS ts, avg(floor(value)) AS current_temp FROM readings WHERE event_type = 'error' GROUP BY ALL)
    SELECT site_id, ts, power, current_temp FROM s FULL JOIN c USING (site_id, ts)""",
)
def _(t):
    def hourly(kind, col, name):
        rows = readings(t).filter(F.col("event_type") == kind)
        return rows.groupBy("site_id", F.window("ts", "1 hour").start.alias("ts")).agg(F.avg(col.cast("double")).alias(name))

    sensor = hourly("click", F.floor(F.col("value") * 10), "power")
    climate = hourly("error", F.floor("value"), "current_temp")
    return ops.outer_align_join(sensor, climate, ("site_id", "ts"))


@query(
    "asof_grid_join",
    f"""WITH {TELEMETRY}, grid AS (
      SELECT entity_id, unnest(generate_series(min({BUCKET}), max({BUCKET}), INTERVAL '1 hour')) AS ts FROM telemetry GROUP BY 1)
    SELECT g.entity_id, g.ts, t.value FROM grid g ASOF LEFT JOIN telemetry t ON g.entity_id = t.entity_id AND t.ts <= g.ts""",
)
def _(t):
    return ops.asof_grid(t.telemetry, t.S, "1 hour", ["value"])


# unstable zones: the power range of the highest three readings of each event type
ZONES = """zones AS (SELECT event_type AS entity_id, min(v) AS lo, max(v) AS hi FROM (
    SELECT event_type, floor(value * 10) AS v, row_number() OVER (PARTITION BY event_type, date_trunc('week', ts) ORDER BY value DESC, ts) AS r FROM events)
  WHERE r <= 3 GROUP BY event_type, r)"""


def zones(t):
    from wattloom.operators.windows import rank_topk

    weekly = t.events.withColumn("week", F.date_trunc("week", "ts"))
    top = rank_topk(weekly, [F.desc("value"), F.asc("ts")], 3, ("event_type", "week"))
    v = F.floor(F.col("value") * 10).cast("double")
    return top.groupBy(F.col("event_type").alias("entity_id"), "rank").agg(
        F.min(v).alias("power_min"), F.max(v).alias("power_max")
    ).withColumn("kind", F.lit("unstable"))


@query(
    "zone_range_join",
    f"""WITH {TELEMETRY}, {ZONES} SELECT entity_id, ts, value,
      EXISTS (SELECT 1 FROM zones z WHERE z.entity_id = t.entity_id AND t.value BETWEEN z.lo AND z.hi) AS in_unstable,
      EXISTS (SELECT 1 FROM zones z WHERE t.value BETWEEN z.lo AND z.hi) AS in_any FROM telemetry t""",
)
def _(t):
    own = ops.zone_range_join(t.telemetry, zones(t), ("entity_id",))
    return ops.zone_range_join(own, zones(t), out="in_any")


_EVENTS = f"""ev AS (SELECT *, lag(phase) OVER ({W}) AS prev FROM phased)"""


def impact(t, width="2 hours"):
    df = lag_phase(phased(t), t.S, "phase")
    event = (F.col("prev_phase") == "stable") & (F.col("phase") == "unstable")
    return ops.event_window(df, t.S, event, ["value"], width)


@query(
    "event_window_join",
    f"""WITH {TELEMETRY}, {PHASED}, {_EVENTS}
    SELECT e.entity_id, e.ts, round(avg(p.value) FILTER (p.us <= e.us), 6) AS value_before, round(avg(p.value) FILTER (p.us >= e.us), 6) AS value_after,
      round(avg(p.value) FILTER (p.us >= e.us) - avg(p.value) FILTER (p.us <= e.us), 6) AS value_delta
    FROM ev e JOIN telemetry p ON p.entity_id = e.entity_id AND p.us BETWEEN e.us - 7200000000 AND e.us + 7200000000
    WHERE e.prev = 'stable' AND e.phase = 'unstable' GROUP BY 1, 2""",
)
def _(t):
    return rounded(impact(t), "value_before", "value_after", "value_delta")


@query("unit_defaults", f"WITH {UNITS} SELECT * FROM units")
def _(t):
    return units(t).select("site_id", "unit_id", "position", "operating_mode", "power_sensor")


ROOM_UNIT = f"""{ROOMS}, {UNITS}, fb AS (SELECT site_id, unit_id, operating_mode FROM units
    QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY unit_id <> 'default', position) = 1),
  room_unit AS (SELECT r.site_id, r.room, coalesce(u.unit_id, fb.unit_id) AS unit_id, coalesce(u.operating_mode, fb.operating_mode) AS operating_mode
    FROM rooms r LEFT JOIN units u ON u.site_id = r.site_id AND u.unit_id = r.outdoor_unit LEFT JOIN fb ON fb.site_id = r.site_id)"""


@query("room_unit_lookup", f"WITH {ROOM_UNIT} SELECT * FROM room_unit")
def _(t):
    return ops.room_unit_lookup(rooms(t), units(t)).select("site_id", "room", "unit_id", "operating_mode")


@query(
    "room_mode_validation",
    f"WITH {ROOM_UNIT} SELECT site_id, unit_id, count(*) AS rooms, min(operating_mode) AS operating_mode, count(DISTINCT operating_mode) = 1 AS valid FROM room_unit GROUP BY 1, 2",
)
def _(t):
    return stats.room_mode_validation(ops.room_unit_lookup(rooms(t), units(t)))


_CLUSTERED = f"""cl AS (SELECT entity_id, ts, us, value, CASE WHEN value > 100 THEN CAST(floor(value / 500) AS INTEGER) END AS cluster FROM telemetry),
  good AS (SELECT cluster FROM cl WHERE cluster IS NOT NULL GROUP BY 1 HAVING stddev_samp(value) < 144)"""


def clustered(t):
    running = t.telemetry.filter("value > 100")
    return running.withColumn("cluster", F.floor(F.col("value") / 500).cast("int"))


def good_clusters(t):
    sd = clustered(t).groupBy("cluster").agg(F.stddev_samp("value").alias("sd"))
    return sd.filter("sd < 144").select("cluster")


@query("label_writeback", f"WITH {TELEMETRY}, {_CLUSTERED} SELECT entity_id, ts, value, coalesce(cluster, -1) AS cluster FROM cl")
def _(t):
    return ops.label_writeback(t.telemetry, clustered(t), ("entity_id", "ts"))


@query(
    "stable_cluster_semi",
    f"""WITH {TELEMETRY}, {_CLUSTERED} SELECT entity_id, ts, coalesce(cluster, -1) AS cluster, CASE WHEN cluster IN (SELECT cluster FROM good) THEN 'stable'
      WHEN cluster >= 0 THEN 'unstable' ELSE 'unknown' END AS label FROM cl""",
)
def _(t):
    back = ops.label_writeback(t.telemetry, clustered(t), ("entity_id", "ts"))
    return ops.stable_cluster_label(back, good_clusters(t)).select("entity_id", "ts", "cluster", "label")


SNAPSHOT = f"""{READINGS}, ticks AS (SELECT DISTINCT site_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS ts FROM readings),
  pw AS (SELECT site_id, ts, CASE WHEN k < 5 THEN 'unavailable' ELSE CAST(floor(value * 10) AS VARCHAR) END AS power FROM readings WHERE event_type = 'click'),
  od AS (SELECT site_id, ts, CASE WHEN k < 5 THEN 'unknown' ELSE CAST(floor(value) / 8.0::DOUBLE - 5 AS VARCHAR) END AS outdoor FROM readings WHERE event_type = 'view'),
  rs AS (SELECT site_id, event_type AS room, ts, CASE WHEN k < 4 THEN 'unavailable' ELSE CAST(18 + floor(value) / 16.0::DOUBLE AS VARCHAR) END AS current_temp,
      CAST(20 + floor(k / 25.0) * 0.5::DOUBLE AS VARCHAR) AS target_temp, CASE WHEN k % 50 < 15 THEN 'off' ELSE 'heat' END AS hvac_mode FROM readings
    WHERE event_type IN ('error', 'purchase', 'signup')),
  a AS (SELECT t.site_id, t.ts, pw.power FROM ticks t ASOF JOIN pw ON t.site_id = pw.site_id AND pw.ts <= t.ts),
  b AS (SELECT a.*, od.outdoor FROM a ASOF JOIN od ON a.site_id = od.site_id AND od.ts <= a.ts),
  c AS (SELECT site_id, ts, CAST(power AS DOUBLE) AS power, CAST(outdoor AS DOUBLE) AS outdoor_temp FROM b WHERE power <> 'unavailable' AND outdoor <> 'unknown'),
  d AS (SELECT c.*, r.room FROM c JOIN (SELECT DISTINCT site_id, room FROM rs) r USING (site_id)),
  snap AS (SELECT d.*, CAST(rs.current_temp AS DOUBLE) AS current_temp, CAST(rs.target_temp AS DOUBLE) AS target_temp, rs.hvac_mode,
      CAST(rs.current_temp AS DOUBLE) - CAST(rs.target_temp AS DOUBLE) AS delta, rs.hvac_mode <> 'off' AS is_on
    FROM d ASOF JOIN (SELECT site_id, room, ts, NULLIF(current_temp, 'unavailable') AS current_temp, target_temp, hvac_mode FROM rs) rs
      ON d.site_id = rs.site_id AND d.room = rs.room AND rs.ts <= d.ts WHERE rs.current_temp IS NOT NULL)"""


def snapshot(t):
    r = readings(t)
    k = F.col("k")
    ticks = r.select("site_id", F.window("ts", "6 hours").start.alias("ts")).distinct()
    power = r.filter("event_type = 'click'").select(
        "site_id", "ts", F.when(k < 5, "unavailable").otherwise(F.floor(F.col("value") * 10).cast("string")).alias("state")
    )
    outdoor = r.filter("event_type = 'view'").select(
        "site_id", "ts", F.when(k < 5, "unknown").otherwise((F.floor("value") / 8.0 - 5).cast("string")).alias("state")
    )
    states = r.filter("event_type in ('error', 'purchase', 'signup')").select(
        "site_id",
        F.col("event_type").alias("room"),
        "ts",
        F.when(k < 4, "unavailable").otherwise((18 + F.floor("value") / 16.0).cast("string")).alias("current_temp"),
        (20 + F.floor(k / 25) * 0.5).cast("string").alias("target_temp"),
        F.when(k % 50 < 15, "off").otherwise("heat").alias("hvac_mode"),
    )
    return ops.state_snapshot(ticks, power, outdoor, states, states.select("site_id", "room").distinct(), t.SITE)


@query("state_snapshot", f"WITH {SNAPSHOT} SELECT * FROM snap")
def _(t):
    return snapshot(t)


@query(
    "on_off_pairing",
    f"""WITH {TELEMETRY}, st AS (SELECT *, coalesce(last_value(CASE WHEN value > 300 THEN 1 WHEN value < 150 THEN 0 END IGNORE NULLS)
      OVER ({W} ROWS UNBOUNDED PRECEDING), 0) AS state FROM telemetry), ch AS (SELECT *, state - lag(state) OVER ({W}) AS chg FROM st)
    SELECT a.entity_id, a.ts AS on_time, b.ts AS off_time FROM ch a ASOF JOIN (SELECT entity_id, ts FROM ch WHERE chg = -1) b
      ON a.entity_id = b.entity_id AND b.ts > a.ts WHERE a.chg = 1""",
)
def _(t):
    return ops.on_off_pairing(hysteresis_state(t.telemetry, t.S, 300, 150), t.S)


NIGHTS = {
    "current": (dt.datetime(2024, 1, 20, 22, tzinfo=UTC), dt.datetime(2024, 1, 21, 9, tzinfo=UTC)),
    "before": (dt.datetime(2024, 1, 19, 22, tzinfo=UTC), dt.datetime(2024, 1, 20, 22, tzinfo=UTC)),
}
NIGHT_SQL = """tagged AS (
    SELECT 'current' AS period, * FROM telemetry WHERE ts BETWEEN TIMESTAMP '2024-01-20 22:00:00' AND TIMESTAMP '2024-01-21 09:00:00'
    UNION ALL SELECT 'before', * FROM telemetry WHERE ts BETWEEN TIMESTAMP '2024-01-19 22:00:00' AND TIMESTAMP '2024-01-20 22:00:00'),
  ns AS (SELECT *, stddev_samp(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS sd, CASE WHEN value > 50 THEN 1 ELSE 0 END AS on_ FROM tagged
    WINDOW w AS (PARTITION BY entity_id, period ORDER BY us)),
  nl AS (SELECT *, lag(on_) OVER (PARTITION BY entity_id, period ORDER BY us) AS was FROM ns),
  night AS (SELECT entity_id, period, CAST(sum(on_) AS BIGINT) AS on_rows,
      CASE WHEN sum(on_) > 0 THEN round(count(*) FILTER (on_ = 1 AND sd >= 400) / sum(on_)::DOUBLE * 100, 6) ELSE 0 END AS unstable_pct,
      CASE WHEN sum(on_) > 0 THEN round(avg(value) FILTER (on_ = 1), 6) ELSE 0 END AS avg_power,
      CASE WHEN sum(on_) > 0 THEN coalesce(sum(abs(on_ - was)), 0) / 2.0::DOUBLE ELSE 0 END AS cycles,
      CASE WHEN sum(on_) > 0 THEN round(count(*) FILTER (on_ = 1 AND value BETWEEN 400 AND 500) / sum(on_)::DOUBLE * 100, 6) ELSE 0 END AS target_zone_pct,
      CASE WHEN sum(on_) > 0 THEN min(value) FILTER (on_ = 1) ELSE 0 END AS min_power, CASE WHEN sum(on_) > 0 THEN max(value) FILTER (on_ = 1) ELSE 0 END AS max_power
    FROM nl GROUP BY 1, 2)"""


def night(t):
    tagged = ops.tag_periods(t.telemetry, "ts", NIGHTS)
    return stats.night_report(tagged, replace(t.S, keys=("entity_id", "period")), calm=400)


@query("night_report", f"WITH {TELEMETRY}, {NIGHT_SQL} SELECT * FROM night")
def _(t):
    return rounded(night(t), "unstable_pct", "avg_power", "target_zone_pct")


@query(
    "period_compare",
    f"""WITH {TELEMETRY}, {NIGHT_SQL} SELECT entity_id, c.unstable_pct AS current_unstable_pct, b.unstable_pct AS before_unstable_pct,
      c.cycles AS current_cycles, b.cycles AS before_cycles, round(c.unstable_pct - b.unstable_pct, 4) AS unstable_pct_delta, c.cycles - b.cycles AS cycles_delta
    FROM (SELECT * FROM night WHERE period = 'current') c JOIN (SELECT * FROM night WHERE period = 'before') b USING (entity_id)""",
)
def _(t):
    metrics = {"unstable_pct": F.max(F.round("unstable_pct", 6)), "cycles": F.max("cycles")}
    out = ops.period_delta(night(t), ("entity_id",), metrics, "before", "current")
    return rounded(out, "unstable_pct_delta", digits=4)


@query(
    "baseline_vs_controller",
    f"""WITH {TELEMETRY}, sd AS (SELECT *, stddev_samp(value) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS std FROM telemetry),
      k AS (SELECT entity_id, CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 'baseline' ELSE 'controller' END AS period, round(avg(std), 6) AS power_std,
        avg(value) AS mean_power, count(*) AS readings FROM sd WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2)
    SELECT entity_id, b.power_std AS baseline_power_std, c.power_std AS controller_power_std, round(c.power_std - b.power_std, 4) AS power_std_delta,
      b.mean_power AS baseline_mean_power, c.mean_power AS controller_mean_power, c.mean_power - b.mean_power AS mean_power_delta,
      b.readings AS baseline_readings, c.readings AS controller_readings, c.readings - b.readings AS readings_delta
    FROM (SELECT * FROM k WHERE period = 'baseline') b JOIN (SELECT * FROM k WHERE period = 'controller') c USING (entity_id)""",
)
def _(t):
    df = stats.with_stability(t.telemetry, t.S, 6)
    days = {
        "baseline": (dt.datetime(2024, 1, 1, tzinfo=UTC), dt.datetime(2024, 1, 7, 23, 59, 59, 999999, tzinfo=UTC)),
        "controller": (dt.datetime(2024, 1, 8, tzinfo=UTC), dt.datetime(2024, 1, 14, 23, 59, 59, 999999, tzinfo=UTC)),
    }
    metrics = {"power_std": F.round(F.avg("power_std"), 6), "mean_power": F.avg("value"), "readings": F.count(F.lit(1))}
    out = ops.period_delta(ops.tag_periods(df, "ts", days), ("entity_id",), metrics, "baseline", "controller")
    return rounded(out, "power_std_delta", digits=4)
