"""Control rules over past states."""

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.registry import READINGS, ROOM_STATE, channels, query, readings, room_state, rounded
from catalog.scans import scratch
from wattloom.operators import policy as ops
from wattloom.plans import control
from wattloom.sources import readers, sinks

RULES = ops.Rules(cooldown_minutes=720.0, emergency_cooldown_minutes=400.0)
CYCLE = ["site_id", "cycle"]

# power and outdoor temperature of the cycle, night from the hour, the mode from the site
CYCLES = f"""{ROOM_STATE}, ch AS (SELECT site_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS cycle,
    avg(CASE WHEN event_type = 'click' THEN floor(value * 10) END) AS power, avg(CASE WHEN event_type = 'view' THEN floor(value) / 8.0::DOUBLE - 5 END) AS outdoor_temp FROM readings GROUP BY 1, 2),
  cyc AS (SELECT site_id, cycle, coalesce(power, 400) AS power, coalesce(outdoor_temp, 0) AS outdoor_temp, power > 900 AS stab FROM ch),
  st0 AS (SELECT c.site_id, c.cycle, any_value(c.power) AS power, any_value(c.outdoor_temp) AS outdoor_temp, coalesce(sum(abs(r.delta)), 0) AS total_delta_abs,
      coalesce(bool_or(r.delta < -1.5 OR r.delta > 1.0), false) AS comfort_emergency, coalesce(any_value(c.stab), false) AS stability_emergency
    FROM cyc c LEFT JOIN rooms_on r USING (site_id, cycle) GROUP BY 1, 2),
  st1 AS (SELECT *, power BETWEEN 300 AND 450 AS in_unstable, comfort_emergency OR stability_emergency AS is_emergency FROM st0),
  st AS (SELECT *, in_unstable AND NOT is_emergency AS gated, -total_delta_abs AS reward_comfort, CASE WHEN in_unstable AND NOT is_emergency THEN -20.0::DOUBLE ELSE 0.0::DOUBLE END AS reward_stability,
      -(power / 500) AS reward_energy FROM st1)"""
WANTED = f"""rm AS (SELECT r.*, s.power, s.is_emergency, hour(r.cycle) >= 23 OR hour(r.cycle) < 6 AS night, CASE WHEN r.site_id % 2 = 0 THEN 'heat' ELSE 'cool' END AS mode,
      'unit_' || (r.site_id % 3) AS unit_id FROM rooms_on r JOIN st s USING (site_id, cycle) WHERE NOT s.gated),
  d1 AS (SELECT *, CASE WHEN night AND is_on AND delta >= -0.5 THEN 'night' WHEN mode = 'heat' AND delta > 2 AND is_on THEN 'hot' END AS off_,
      CASE WHEN delta < -1.5 AND NOT is_on THEN 'on' WHEN delta < -1.5 AND least(target_temp + 0.5, 24) <> target_temp THEN 'up'
        WHEN delta >= -1.5 AND delta > 1.0 AND is_on AND greatest(target_temp - 0.5, 16) <> target_temp THEN 'down' END AS com,
      power < 500 AND NOT is_on AND delta < -0.5 AS load_, format('{{:.1f}}', delta) AS d FROM rm),
  wanted AS (
    SELECT site_id, cycle, room, delta, is_emergency, 0 AS action_no, 'turn_off' AS action_type, NULL::DOUBLE AS old_target, NULL::DOUBLE AS new_target,
      CASE off_ WHEN 'night' THEN 'Night mode (Δ=' || d || 'K, ok to turn off)' ELSE 'Overheating (' || d || 'K above target)' END AS reason, NULL AS unit_id FROM d1 WHERE off_ IS NOT NULL
    UNION ALL SELECT site_id, cycle, room, delta, is_emergency, 0, CASE com WHEN 'on' THEN 'turn_on' ELSE 'adjust_target' END, CASE WHEN com <> 'on' THEN target_temp END,
      CASE com WHEN 'up' THEN least(target_temp + 0.5, 24) WHEN 'down' THEN greatest(target_temp - 0.5, 16) END,
      CASE com WHEN 'on' THEN 'Too cold (' || d || 'K), unit=' || unit_id WHEN 'up' THEN 'Too cold (' || d || 'K)' ELSE 'Too warm (' || d || 'K)' END,
      CASE WHEN com = 'on' THEN unit_id END FROM d1 WHERE off_ IS NULL AND com IS NOT NULL
    UNION ALL SELECT site_id, cycle, room, delta, is_emergency, CASE WHEN com IS NULL THEN 0 ELSE 1 END, 'turn_on', NULL, NULL,
      'Stability targeting (power=' || CAST(round_even(power, 0) AS BIGINT) || 'W)', unit_id FROM d1 WHERE off_ IS NULL AND load_)"""
LOG = """actlog AS (SELECT user_id % 10 AS site_id, event_type AS room, ts AS cycle FROM events WHERE value > 60)"""
CAPPED = """capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, cycle ORDER BY abs(delta) DESC, room, action_no) AS action_rank FROM wanted) WHERE action_rank <= 2)"""
_ACT = "site_id, cycle, room, delta, action_no, action_type, old_target, new_target, reason, unit_id"


def cycles(t):
    ch = channels(t).withColumnRenamed("ts", "cycle")
    return ch.select(
        "site_id",
        "cycle",
        F.coalesce("power", F.lit(400.0)).alias("power"),
        F.coalesce("outdoor_temp", F.lit(0.0)).alias("outdoor_temp"),
        F.coalesce(F.col("power") > 900, F.lit(False)).alias("stability_emergency"),
    )


def the_zones(t):
    # the range of a site's own lowest power counts as unstable
    return cycles(t).groupBy("site_id").agg(F.lit("unstable").alias("kind"), F.lit(300.0).alias("power_min"), F.lit(450.0).alias("power_max"))


def states(t):
    return control.cycle_states(room_state(t), cycles(t), the_zones(t), t.SITE_CYCLE, RULES, ("site_id",))


def rooms(t):
    site = F.col("site_id") % 3
    return room_state(t).withColumns(
        {
            "is_night": (F.hour("cycle") >= 23) | (F.hour("cycle") < 6),
            "operating_mode": F.when(F.col("site_id") % 2 == 0, "heat").otherwise("cool"),
            "unit_id": F.concat(F.lit("unit_"), site),
        }
    )


def wanted(t):
    return ops.room_actions(control.candidate_rooms(rooms(t), states(t), t.SITE_CYCLE), RULES)


def log(t):
    return readings(t).filter("value > 60").select("site_id", F.col("event_type").alias("room"), F.col("ts").alias("cycle"))


_FIELDS = ["site_id", "cycle", "room", "delta", "action_no", *ops.ACTION_FIELDS]


def unit_names(df):
    return df.withColumn("unit_id", F.col("a_unit_id")).drop("a_unit_id") if "a_unit_id" in df.columns else df


@query(
    "can_act",
    f"""WITH {READINGS}, dec AS (SELECT site_id, ts, us, CASE WHEN k < 10 THEN 'observation' WHEN k < 20 THEN 'manual' ELSE 'active' END AS mode FROM readings),
      a AS (SELECT site_id, ts AS ats FROM readings WHERE value > 60)
    SELECT d.site_id, d.ts, d.mode, a.ats AS last_action, d.mode = 'active' AND coalesce(epoch_us(d.ts) - epoch_us(a.ats) >= 3600000000, true) AS can_act
    FROM dec d ASOF LEFT JOIN a ON d.site_id = a.site_id AND a.ats < d.ts""",
)
def _(t):
    k = F.col("k")
    mode = F.when(k < 10, "observation").when(k < 20, "manual").otherwise("active")
    decisions = readings(t).select("site_id", "ts", mode.alias("mode"))
    acted = readings(t).filter("value > 60").select("site_id", "ts")
    return ops.can_act(decisions, acted, replace(t.SITE, value="value"), interval_minutes=60)


@query("gate_cycle", f"WITH {CYCLES} SELECT site_id, cycle, comfort_emergency, stability_emergency, in_unstable, is_emergency, gated FROM st")
def _(t):
    return states(t).select(*CYCLE, "comfort_emergency", "stability_emergency", "in_unstable", "is_emergency", "gated")


@query(
    "reward",
    f"""WITH {CYCLES} SELECT site_id, cycle, reward_comfort, reward_stability, round(reward_energy, 6) AS reward_energy,
      round(reward_comfort + reward_stability + reward_energy, 6) AS reward_total FROM st""",
)
def _(t):
    df = states(t).select(*CYCLE, "reward_comfort", "reward_stability", "reward_energy", "reward_total")
    return rounded(df, "reward_energy", "reward_total")


@query("room_actions", f"WITH {CYCLES}, {WANTED} SELECT {_ACT} FROM wanted")
def _(t):
    return unit_names(wanted(t)).select(*_FIELDS)


@query(
    "cooldown_filter",
    f"""WITH {CYCLES}, {WANTED}, {LOG} SELECT r.site_id, r.cycle, r.room, r.delta FROM rm r ASOF LEFT JOIN actlog l ON r.site_id = l.site_id AND r.room = l.room AND l.cycle < r.cycle
    WHERE coalesce((epoch_us(r.cycle) - epoch_us(l.cycle)) / 6e7 >= CASE WHEN is_emergency THEN 400 ELSE 720 END, true)""",
)
def _(t):
    df = control.candidate_rooms(rooms(t), states(t), t.SITE_CYCLE)
    return ops.cooldown_filter(df, log(t), t.AT_ROOM, RULES).select(*CYCLE, "room", "delta")


@query("cap_actions", f"WITH {CYCLES}, {WANTED}, {CAPPED} SELECT {_ACT}, action_rank FROM capped")
def _(t):
    df = ops.cap_actions(wanted(t), CYCLE, RULES.max_actions)
    return unit_names(df).select(*_FIELDS, "action_rank")


@query(
    "cap_actions_single",
    f"WITH {CYCLES}, {WANTED}, {CAPPED} SELECT site_id, cycle, room, action_type, action_rank FROM capped JOIN st USING (site_id, cycle) WHERE action_rank = 1 OR total_delta_abs <= 10",
)
def _(t):
    df = ops.cap_actions(wanted(t), CYCLE, RULES.max_actions, single_above=10.0)
    return df.select(*CYCLE, "room", "action_type", "action_rank")


@query(
    "open_loop_backtest",
    f"""WITH {CYCLES}, {WANTED}, {LOG}, ready AS (SELECT r.site_id, r.cycle, r.room FROM rm r ASOF LEFT JOIN actlog l ON r.site_id = l.site_id AND r.room = l.room AND l.cycle < r.cycle
      WHERE coalesce((epoch_us(r.cycle) - epoch_us(l.cycle)) / 6e7 >= CASE WHEN is_emergency THEN 400 ELSE 720 END, true))
    SELECT site_id, cycle, room, action_type, action_rank FROM (SELECT w.*, row_number() OVER (PARTITION BY site_id, cycle ORDER BY abs(delta) DESC, room, action_no) AS action_rank
      FROM wanted w JOIN ready USING (site_id, cycle, room)) WHERE action_rank <= 2""",
)
def _(t):
    df = control.open_loop(rooms(t), states(t), log(t), t.SITE_CYCLE, RULES)
    return df.select(*CYCLE, "room", "action_type", "action_rank")


@query("closed_loop_backtest")
def _(t):
    return control.closed_loop(rooms(t), states(t), t.SITE_CYCLE, RULES)


EPISODES = f"""{CYCLES}, {WANTED}, {CAPPED}, n AS (SELECT site_id, cycle, count(*) AS n FROM capped GROUP BY 1, 2),
  rc AS (SELECT site_id, cycle, count(*) AS rooms, sum(delta) AS d FROM rooms_on GROUP BY 1, 2),
  ep AS (SELECT st.*, coalesce(n.n, 0) AS actions, rc.rooms, rc.d FROM st LEFT JOIN n USING (site_id, cycle) LEFT JOIN rc USING (site_id, cycle))"""


def the_episodes(t):
    acts = ops.cap_actions(wanted(t), CYCLE, RULES.max_actions)
    units = rooms(t).select("site_id", "unit_id", "operating_mode").distinct()
    return control.episodes(rooms(t), states(t), acts, t.SITE_CYCLE, units=units)


@query(
    "build_episodes",
    f"""WITH {EPISODES} SELECT site_id, cycle, power, outdoor_temp, total_delta_abs, CAST(actions AS INTEGER) AS actions, CAST(rooms AS INTEGER) AS rooms, d AS delta_sum,
      round(reward_comfort + reward_stability + reward_energy, 6) AS reward_total, CASE WHEN site_id % 2 = 0 THEN 'heat' ELSE 'cool' END AS mode FROM ep""",
)
def _(t):
    df = the_episodes(t)
    values = F.map_values("state.rooms")
    return df.select(
        *CYCLE,
        "state.power",
        "state.outdoor_temp",
        "state.total_delta_abs",
        F.size("actions").alias("actions"),
        F.size("state.rooms").alias("rooms"),
        F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("delta_sum"),
        F.round("reward.total", 6).alias("reward_total"),
        F.map_values("outdoor_units")[0].alias("mode"),
    )


@query(
    "append_episodes",
    f"""WITH {EPISODES} SELECT site_id, cycle, power, CAST(actions AS INTEGER) AS actions, round(reward_comfort + reward_stability + reward_energy, 6) AS reward_total FROM ep""",
)
def _(t):
    path = scratch(t, "episodes")
    df = the_episodes(t).withColumnRenamed("cycle", "ts").withColumn("site_id", F.col("site_id").cast("long"))
    sinks.append_episodes(df.filter("site_id < 5"), path)
    sinks.append_episodes(df.filter("site_id >= 5"), path)
    back = readers.read_episodes(t.spark, path)
    return back.select("site_id", F.col("ts").alias("cycle"), "state.power", F.size("actions").alias("actions"), F.round("reward.total", 6).alias("reward_total"))


_EPISODE_STATS = f"""WITH {EPISODES} SELECT site_id, count(*) AS episodes, round(avg(reward_comfort + reward_stability + reward_energy), 6) AS avg_reward, round(avg(actions), 6) AS avg_actions,
      round(avg(total_delta_abs), 6) AS avg_total_delta_abs FROM ep GROUP BY 1"""


@query("episode_stats", _EPISODE_STATS)
def _(t):
    return rounded(ops.episode_stats(the_episodes(t), ("site_id",)), "avg_reward", "avg_actions", "avg_total_delta_abs")


@query("read_episodes", _EPISODE_STATS)
def _(t):
    path = scratch(t, "episodes")
    sinks.append_episodes(the_episodes(t).withColumnRenamed("cycle", "ts"), path)
    stored = readers.read_episodes(t.spark, path)
    return rounded(ops.episode_stats(stored, ("site_id",)), "avg_reward", "avg_actions", "avg_total_delta_abs")


# unit strategies: one decision per site and cycle, the rooms are the units
POLICY = f"""{CYCLES}, un AS (SELECT site_id, cycle, arg_min(room, CASE room WHEN 'view' THEN 10 WHEN 'click' THEN 90 ELSE 50 END * 100 + ascii(room)) FILTER (NOT is_on) AS off_,
      arg_min(room, room) FILTER (is_on AND target_temp < 21.5) AS on_, arg_min(target_temp, room) FILTER (is_on AND target_temp < 21.5) AS cur FROM rooms_on GROUP BY 1, 2),
  p0 AS (SELECT st.*, hour(cycle) < 6 AS night, off_, on_, cur, least(1.0::DOUBLE, total_delta_abs / 10) AS risk, floor(total_delta_abs * 4) AS sd, floor(total_delta_abs * 20) AS sp FROM st LEFT JOIN un USING (site_id, cycle)),
  p1 AS (SELECT *, risk > 0.6 OR sd > 50 OR sp > 300 AS is_unstable, power < 450 AS low FROM p0),
  p2 AS (SELECT *, CASE WHEN cur + 0.3::DOUBLE <= 22.5 THEN cur + 0.3::DOUBLE WHEN cur - 0.3::DOUBLE >= 19.5 THEN cur - 0.3::DOUBLE END AS nudged FROM p1),
  pol AS (SELECT *, CASE WHEN NOT is_unstable AND NOT low THEN NULL WHEN night AND is_unstable AND off_ IS NOT NULL THEN 'night' WHEN (low OR is_unstable) AND off_ IS NOT NULL THEN 'stability'
      WHEN is_unstable AND nudged IS NOT NULL THEN 'nudge' END AS strategy FROM p2)"""


def policy_rows(t):
    priority = F.when(F.col("room") == "view", 10).when(F.col("room") == "click", 90)
    target = F.when(F.col("target_temp") < 21.5, F.col("target_temp"))
    unit = F.struct(F.col("room").alias("name"), "is_on", target.alias("target_temp"), priority.alias("priority"))
    units = room_state(t).groupBy(*CYCLE).agg(F.sort_array(F.collect_list(unit)).alias("units"))
    total = F.col("total_delta_abs")
    return states(t).join(units, CYCLE, "left").withColumns(
        {
            "is_night": F.hour("cycle") < 6,
            "cycling_risk": F.least(F.lit(1.0), total / 10),
            "power_std": F.floor(total * 4).cast("double"),
            "power_spread": F.floor(total * 20).cast("double"),
            "min_stable_power": F.lit(450.0),
        }
    )


_POL_COLS = ["site_id", "cycle", "is_unstable", "strategy", "action_type", "target_unit", "temperature", "fan_mode", "previous", "reason"]


@query(
    "policy_v2",
    f"""WITH {POLICY} SELECT site_id, cycle, is_unstable, strategy, CASE WHEN strategy IN ('night', 'stability') THEN 'enable_unit' WHEN strategy = 'nudge' THEN 'adjust_temp' ELSE 'no_action' END AS action_type,
      CASE WHEN strategy IN ('night', 'stability') THEN off_ WHEN strategy = 'nudge' THEN on_ END AS target_unit, round(CASE strategy WHEN 'night' THEN 19.0 WHEN 'stability' THEN 20.5 WHEN 'nudge' THEN nudged END, 6) AS temperature,
      CASE strategy WHEN 'night' THEN 'low' WHEN 'stability' THEN 'auto' END AS fan_mode, CASE WHEN strategy = 'nudge' THEN cur END AS previous,
      CASE WHEN strategy = 'night' THEN 'Night Mode: ' || off_ || ' als Puffer aktiviert (19.0°C) für Stabilität.'
        WHEN strategy = 'stability' THEN 'Stabilitäts-Targeting: ' || off_ || ' aktiviert (Ziel >450W, σ=' || CAST(sd AS BIGINT) || 'W).'
        WHEN strategy = 'nudge' THEN 'Gradual Nudge: ' || on_ || ' um 0.3°C angepasst zur Stabilisierung.' WHEN NOT is_unstable AND NOT low THEN 'System stabil und effizient.' ELSE 'Keine passende Intervention gefunden.' END AS reason
    FROM pol""",
)
def _(t):
    return rounded(ops.policy_v2(policy_rows(t)).select(*_POL_COLS), "temperature")


@query(
    "policy_stats",
    f"""WITH {POLICY} SELECT site_id, count(strategy) AS actions_taken, count(*) FILTER (strategy = 'stability') AS stability_actions, count(*) FILTER (strategy = 'night') AS night_mode_actions,
      count(*) FILTER (strategy = 'nudge') AS gradual_nudges, count(*) FILTER (strategy IN ('night', 'stability')) AS enable_unit, count(*) FILTER (strategy = 'nudge') AS adjust_temp FROM pol GROUP BY 1""",
)
def _(t):
    return ops.policy_stats(ops.policy_v2(policy_rows(t)), ["site_id"])


@query(
    "last_actions",
    f"""WITH {POLICY} SELECT site_id, cycle, strategy, row_number() OVER (PARTITION BY site_id ORDER BY cycle DESC) AS recency FROM pol WHERE strategy IS NOT NULL QUALIFY recency <= 5""",
)
def _(t):
    return ops.last_actions(ops.policy_v2(policy_rows(t)), t.SITE_CYCLE).select("site_id", "cycle", "strategy", "recency")


@query(
    "replay_policy",
    f"""WITH {POLICY}, r AS (SELECT *, off_ IS NOT NULL AS has_off FROM pol WHERE risk > 0.6)
    SELECT site_id, cycle, CASE WHEN has_off AND night THEN 'night' WHEN has_off THEN 'stability' ELSE 'nudge' END AS strategy, CASE WHEN has_off THEN off_ ELSE on_ END AS target_unit,
      CASE WHEN risk > 0.7 THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END AS power_std FROM r WHERE has_off OR nudged IS NOT NULL""",
)
def _(t):
    return ops.replay_policy(policy_rows(t)).select("site_id", "cycle", "strategy", "target_unit", "power_std")
