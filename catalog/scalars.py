"""Scalar expressions over readings."""

from pyspark.sql import functions as F

from catalog.registry import CHANNELS, READINGS, ROOM_STATE, TELEMETRY, W, channels, query, r6, room_state
from catalog.scans import states
from wattloom.functions import scalar as fn
from wattloom.operators.stats import with_stability

STAB = f"""stab AS (SELECT *, max(value) OVER w - min(value) OVER w AS spread, stddev_samp(value) OVER w AS std FROM telemetry
  WINDOW w AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


def stab(t):
    return with_stability(t.telemetry, t.S)


@query("filter_running", f"WITH {TELEMETRY} SELECT entity_id, ts, value FROM telemetry WHERE value > 50")
def _(t):
    return t.telemetry.filter(F.col("value") > 50)


@query("clip", f"WITH {TELEMETRY}, {STAB} SELECT entity_id, ts, CASE WHEN std IS NOT NULL THEN round(least(greatest(std / 500, 0), 1), 6) END AS clipped FROM stab")
def _(t):
    return stab(t).select("entity_id", "ts", r6(fn.clip(F.col("power_std") / 500, 0, 1)).alias("clipped"))


@query(
    "phase_classify",
    f"""WITH {TELEMETRY}, {STAB} SELECT entity_id, ts, CASE WHEN std < 250 THEN 'stable' WHEN std > 500 THEN 'unstable' ELSE 'neutral' END AS phase FROM stab""",
)
def _(t):
    return stab(t).select("entity_id", "ts", fn.phase("power_std", 250, 500).alias("phase"))


@query(
    "phase_flags",
    f"""WITH {TELEMETRY}, {STAB} SELECT entity_id, ts, coalesce(std < 250, false) AS is_stable, coalesce(std > 600, false) AS is_unstable,
      coalesce(std < 300, false) AS night_stable, coalesce(std >= 300, false) AND value > 50 AS night_unstable FROM stab""",
)
def _(t):
    stable, unstable = fn.phase_flags("power_std", 250, 600)
    n_stable, n_unstable = fn.night_flags("power_std", "value", 300, 50)
    return stab(t).select(
        "entity_id",
        "ts",
        stable.alias("is_stable"),
        unstable.alias("is_unstable"),
        n_stable.alias("night_stable"),
        n_unstable.alias("night_unstable"),
    )


@query("risk_std", f"WITH {TELEMETRY}, {STAB} SELECT entity_id, ts, CASE WHEN std IS NOT NULL THEN round(least(greatest(std / 600, 0), 1), 6) END AS risk FROM stab")
def _(t):
    return stab(t).select("entity_id", "ts", r6(fn.risk_std("power_std", 600)).alias("risk"))


@query(
    "risk_std_spread",
    f"""WITH {TELEMETRY}, {STAB} SELECT entity_id, ts, round(0.6::DOUBLE * least(greatest(std / 600, 0), 1) + 0.4::DOUBLE * least(greatest(spread / 2000, 0), 1), 6) AS risk
    FROM (SELECT entity_id, ts, std, spread FROM stab WHERE std IS NOT NULL) UNION ALL SELECT entity_id, ts, NULL FROM stab WHERE std IS NULL""",
)
def _(t):
    return stab(t).select("entity_id", "ts", r6(fn.risk_std_spread("power_std", "power_spread", 600, 2000)).alias("risk"))


@query(
    "cyclic_time",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos,
      CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM events""",
)
def _(t):
    return t.events.select(
        "event_id",
        F.hour("ts").alias("hour"),
        (r6(fn.hour_sin("ts")) + 0.0).alias("hour_sin"),
        (r6(fn.hour_cos("ts")) + 0.0).alias("hour_cos"),
        fn.weekday("ts").alias("weekday"),
        fn.is_weekend("ts").alias("is_weekend"),
    )


@query("hour_from_cyclic", "SELECT event_id, CAST(hour(ts) AS DOUBLE) AS hour FROM events")
def _(t):
    hour = F.round(fn.hour_from_cyclic(fn.hour_sin("ts"), fn.hour_cos("ts")), 6)
    return t.events.select("event_id", F.pmod(hour, F.lit(24.0)).alias("hour"))


@query("night_predicate", "SELECT event_id, hour(ts) >= 23 OR hour(ts) < 6 AS is_night, hour(ts + INTERVAL 1 HOUR) >= 23 OR hour(ts + INTERVAL 1 HOUR) < 6 AS is_night_berlin FROM events")
def _(t):
    # January: Berlin is one hour ahead
    return t.events.select("event_id", fn.is_night("ts").alias("is_night"), fn.is_night("ts", "Europe/Berlin").alias("is_night_berlin"))


@query("temp_deviation", f"WITH {ROOM_STATE} SELECT site_id, cycle, room, delta, abs(delta) AS delta_abs FROM rooms_on")
def _(t):
    return room_state(t).select("site_id", "cycle", "room", "delta", F.abs("delta").alias("delta_abs"))


@query("total_delta_abs", f"WITH {ROOM_STATE} SELECT site_id, cycle, coalesce(sum(abs(delta)), 0) AS total_delta_abs FROM rooms_on GROUP BY 1, 2")
def _(t):
    from wattloom.operators.policy import total_delta_abs

    return total_delta_abs(room_state(t), ("site_id", "cycle"))


@query(
    "target_changed",
    f"""WITH {CHANNELS} SELECT site_id, ts, CASE WHEN abs(target_eg - lag(target_eg) OVER w) > 0.1 THEN 1 ELSE 0 END AS target_eg_changed,
      CASE WHEN abs(target_eg - lag(target_eg) OVER w) > 0.1 OR abs(unit_eg - lag(unit_eg) OVER w) > 0.1 THEN 1 ELSE 0 END AS any_changed
    FROM channels WINDOW w AS (PARTITION BY site_id ORDER BY us)""",
)
def _(t):
    from wattloom.operators.features import target_changed

    df = target_changed(channels(t), t.SITE, ["target_eg", "unit_eg"], any_out="any_changed")
    return df.select("site_id", "ts", "target_eg_changed", "any_changed")


@query(
    "active_units",
    f"""WITH {CHANNELS} SELECT site_id, ts, CASE WHEN coalesce(unit_eg, 0) > 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(outdoor_temp, 0) > 0 THEN 1 ELSE 0 END AS active_units,
      CASE WHEN coalesce(unit_eg, 0) <> 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(outdoor_temp, 0) <> 0 THEN 1 ELSE 0 END AS nonzero_units FROM channels""",
)
def _(t):
    on = ["unit_eg", "outdoor_temp"]
    return channels(t).select(
        "site_id", "ts", fn.active_units(on).alias("active_units"), fn.active_units(on, nonzero=True).alias("nonzero_units")
    )


_BINS = " ".join(f"WHEN value <= {b} THEN '{a}-{b}'" for a, b in zip(fn.BIN_EDGES, fn.BIN_EDGES[1:]))
_BANDS = " ".join(f"WHEN value >= {a} AND value < {b} THEN '{a}-{b}'" for a, b in fn.DISTRIBUTION_BANDS)


@query("power_bins_right", f"WITH {TELEMETRY} SELECT entity_id, ts, CASE WHEN value < 0 THEN NULL {_BINS} END AS power_bin FROM telemetry")
def _(t):
    return t.telemetry.select("entity_id", "ts", fn.power_bin_right("value").alias("power_bin"))


@query("power_bands_left", f"WITH {TELEMETRY} SELECT entity_id, ts, CASE {_BANDS} END AS band FROM telemetry")
def _(t):
    return t.telemetry.select("entity_id", "ts", fn.power_band_left("value").alias("band"))


@query("strip_entity_prefix", "SELECT event_id, event_type AS entity FROM events")
def _(t):
    return t.events.select("event_id", fn.strip_entity_prefix(F.concat(F.lit("sensor."), "event_type")).alias("entity"))


@query(
    "drop_unavailable",
    f"""WITH {READINGS} SELECT entity_id, ts, CASE WHEN k < 25 THEN 'on' ELSE CAST(value AS VARCHAR) END AS state FROM readings WHERE k >= 20""",
)
def _(t):
    return states(t).filter(fn.is_available("state"))


@query("is_on_flag", f"WITH {ROOM_STATE} SELECT site_id, cycle, room, is_on FROM rooms_on")
def _(t):
    return room_state(t).select("site_id", "cycle", "room", "is_on")


@query("drop_incomplete", f"WITH {CHANNELS} SELECT site_id, ts, power, outdoor_temp FROM channels WHERE power IS NOT NULL AND outdoor_temp IS NOT NULL")
def _(t):
    return channels(t).select("site_id", "ts", "power", "outdoor_temp").na.drop(subset=["power", "outdoor_temp"])


@query(
    "region_label",
    f"""WITH {TELEMETRY}, r AS (SELECT entity_id, avg(value) AS a, min(value) AS lo, max(value) AS hi FROM telemetry GROUP BY 1)
    SELECT entity_id, CAST(round_even(a, 0) AS BIGINT) || 'W avg (' || CAST(lo AS BIGINT) || '-' || CAST(hi AS BIGINT) || 'W)' ||
      CASE WHEN hi < 3500 THEN ' [STABIL]' WHEN hi > 4000 THEN ' [TAKTE]' ELSE '' END AS name FROM r""",
)
def _(t):
    r = t.telemetry.groupBy("entity_id").agg(F.avg("value").alias("a"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    score = F.when(F.col("hi") < 3500, 0.9).when(F.col("hi") > 4000, 0.1).otherwise(0.5)
    return r.select("entity_id", fn.region_label("a", "lo", "hi", score).alias("name"))


@query("stability_grade", f"WITH {TELEMETRY}, {STAB} SELECT entity_id, ts, CASE WHEN std < 250 THEN 'stable' WHEN std < 500 THEN 'moderate' ELSE 'unstable' END AS grade FROM stab")
def _(t):
    return stab(t).select("entity_id", "ts", fn.stability_grade("power_std", 250, 500).alias("grade"))


@query("label_binary", f"WITH {TELEMETRY}, {STAB} SELECT entity_id, ts, CASE WHEN std > 500 THEN 1 ELSE 0 END AS target FROM stab WHERE std < 250 OR std > 500")
def _(t):
    from wattloom.operators.features import label_binary

    return label_binary(stab(t), "power_std", 250, 500).select("entity_id", "ts", "target")


@query("dashboard_round", f"WITH {TELEMETRY}, {STAB} SELECT entity_id, ts, round_even(std / 600, 3) AS score, CAST(round_even(std / 600 * 100, 0) AS INTEGER) AS pct FROM stab")
def _(t):
    score = F.col("power_std") / 600
    return stab(t).select("entity_id", "ts", fn.dashboard_round(score, 3).alias("score"), fn.percent_int(score).alias("pct"))
