"""Control rules evaluated over tables of past states."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.scalar import fixed_text, flag
from wattloom.operators.joins import asof_join
from wattloom.series import Series


@dataclass(frozen=True)
class Rules:
    """Thresholds of the room rules."""

    cold: float = 1.5
    warm: float = 1.0
    step: float = 0.5
    target_min: float = 16.0
    target_max: float = 24.0
    cooldown_minutes: float = 15.0
    emergency_cooldown_minutes: float = 7.0
    max_actions: int = 2
    overheating: float = 2.0
    night_slack: float = -0.5
    low_power: float = 500.0


@dataclass(frozen=True)
class Comfort:
    """Settings of the unit strategies."""

    target_temp: float = 21.0
    night_temp: float = 19.0
    max_deviation: float = 1.5
    nudge: float = 0.3
    max_std: float = 50.0
    max_spread: float = 300.0
    max_risk: float = 0.6
    default_priority: int = 50


UNIT_SCHEMA = "array<struct<name: string, is_on: boolean, target_temp: double, priority: int>>"


def total_delta_abs(rooms: DataFrame, cycle: Sequence[str]) -> DataFrame:
    """Sum of the absolute deviations of all rooms; unknown ones are skipped, none gives 0."""
    total = F.coalesce(F.sum(F.abs("delta")), F.lit(0.0))
    return rooms.groupBy(*cycle).agg(total.alias("total_delta_abs"))


def minutes_since(now: str, then: str) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(60e6)


def can_act(decisions: DataFrame, actions: DataFrame, s: Series, mode: str = "mode", interval_minutes: float = 10.0) -> DataFrame:
    """Acting is allowed unless the mode is passive or the last action is too recent."""
    log = actions.withColumn("last_action", F.col(s.ts))
    seen = asof_join(decisions, log, s, ["last_action"], strict=True)
    rested = F.coalesce(minutes_since(s.ts, "last_action") >= interval_minutes, F.lit(True))
    active = ~F.col(mode).isin("observation", "manual")
    return seen.withColumn("can_act", active & rested)


def _pick(units: Column, wanted) -> Column:
    """The unit with the lowest priority number among those wanted, the first on a tie."""
    placed = F.transform(
        units,
        lambda u, i: F.struct(
            u["priority"].alias("priority"), i.alias("position"), u["name"].alias("name"), u["is_on"].alias("is_on"), u["target_temp"].alias("target_temp")
        ),
    )
    return F.array_min(F.filter(placed, wanted))


def policy_v2(df: DataFrame, comfort: Comfort = Comfort(), units: str = "units") -> DataFrame:
    """One decision per state row: strategy, action_type, target_unit, temperature, ...

    Rows have power, cycling_risk, power_std, power_spread, min_stable_power, is_night and
    ``units`` (see UNIT_SCHEMA).
    """
    c = comfort
    u = F.transform(
        F.col(units).cast(UNIT_SCHEMA),
        lambda x: x.withField("priority", F.coalesce(x["priority"], F.lit(c.default_priority))),
    )
    off = _pick(u, lambda x: ~x["is_on"])
    # the first running unit counts, whatever its priority
    running = F.get(F.filter(u, lambda x: x["is_on"] & x["target_temp"].isNotNull()), F.lit(0))
    df = df.withColumns({"_off": off, "_on": running})

    unstable = (
        flag(F.col("cycling_risk") > c.max_risk)
        | flag(F.col("power_std") > c.max_std)
        | flag(F.col("power_spread") > c.max_spread)
    )
    low = F.col("power") < F.col("min_stable_power")
    has_off = F.col("_off").isNotNull()
    now = F.col("_on.target_temp")
    up, down = now + c.nudge, now - c.nudge
    nudged = F.when(up <= c.target_temp + c.max_deviation, up).when(down >= c.target_temp - c.max_deviation, down)
    df = df.withColumns({"is_unstable": unstable, "_nudged": nudged})
    unstable = F.col("is_unstable")
    strategy = (
        F.when(~unstable & ~low, F.lit(None))
        .when(F.col("is_night") & unstable & has_off, "night")
        .when((low | unstable) & has_off, "stability")
        .when(unstable & F.col("_nudged").isNotNull(), "nudge")
    )
    df = df.withColumn("strategy", strategy)
    s = F.col("strategy")
    enable = s.isin("night", "stability")
    # fixed values: texts of the decisions
    reason = (
        F.when(
            s == "night",
            F.format_string("Night Mode: %s als Puffer aktiviert (%s°C) für Stabilität.", "_off.name", F.lit(str(c.night_temp))),
        )
        .when(
            s == "stability",
            F.format_string(
                "Stabilitäts-Targeting: %s aktiviert (Ziel >%sW, σ=%sW).",
                "_off.name",
                fixed_text("min_stable_power", 0),
                fixed_text("power_std", 0),
            ),
        )
        .when(s == "nudge", F.format_string("Gradual Nudge: %s um 0.3°C angepasst zur Stabilisierung.", "_on.name"))
        .when(~unstable & ~low, "System stabil und effizient.")
        .otherwise("Keine passende Intervention gefunden.")
    )
    return df.withColumns(
        {
            "action_type": F.when(enable, "enable_unit").when(s == "nudge", "adjust_temp").otherwise("no_action"),
            "target_unit": F.when(enable, F.col("_off.name")).when(s == "nudge", F.col("_on.name")),
            "temperature": F.when(s == "night", c.night_temp)
            .when(s == "stability", c.target_temp - 0.5)
            .when(s == "nudge", F.col("_nudged")),
            "fan_mode": F.when(s == "night", "low").when(s == "stability", "auto"),
            "previous": F.when(s == "nudge", F.col("_on.target_temp")),
            "reason": reason,
        }
    ).drop("_off", "_on", "_nudged")


def policy_stats(decisions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How often each strategy and each action type was chosen."""
    s, a = F.col("strategy"), F.col("action_type")
    return decisions.groupBy(*keys).agg(
        F.count_if(a != "no_action").alias("actions_taken"),
        F.count_if(s == "stability").alias("stability_actions"),
        F.count_if(s == "night").alias("night_mode_actions"),
        F.count_if(s == "nudge").alias("gradual_nudges"),
        F.count_if(a == "enable_unit").alias("enable_unit"),
        F.count_if(a == "adjust_temp").alias("adjust_temp"),
    )


def last_actions(decisions: DataFrame, s: Series, n: int = 5) -> DataFrame:
    """The newest n actions of each series."""
    newest = Window.partitionBy(*s.keys).orderBy(F.desc(s.ts))
    acted = decisions.filter("action_type <> 'no_action'").withColumn("recency", F.row_number().over(newest))
    return acted.filter(F.col("recency") <= n)


ACTION_FIELDS = ("action_type", "old_target", "new_target", "reason", "unit_id")


def _action(kind: str, reason: Column, old: Column | None = None, new: Column | None = None, unit: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("action_type"),
        (none.cast("double") if old is None else old).alias("old_target"),
        (none.cast("double") if new is None else new).alias("new_target"),
        reason.alias("reason"),
        (none.cast("string") if unit is None else unit.cast("string")).alias("unit_id"),
    )


def room_decisions(rules: Rules = Rules()) -> Column:
    """Array of the zero to two actions of a room row.

    The row has delta, target_temp, is_on, power, is_night, operating_mode and unit_id.
    """
    r = rules
    delta, target, on = F.col("delta"), F.col("target_temp"), F.col("is_on")
    unit = F.col("unit_id").cast("string")
    # fixed values: texts of the decisions
    d1 = fixed_text(delta, 1)
    night = F.col("is_night") & on & (delta >= r.night_slack)
    hot = (F.col("operating_mode") == "heat") & (delta > r.overheating) & on
    raised = F.least(target + r.step, F.lit(r.target_max))
    lowered = F.greatest(target - r.step, F.lit(r.target_min))
    cold, warm = delta < -r.cold, delta > r.warm
    too_cold = F.format_string("Too cold (%sK)", d1)
    turn_off = F.when(night, _action("turn_off", F.format_string("Night mode (Δ=%sK, ok to turn off)", d1))).when(
        hot, _action("turn_off", F.format_string("Overheating (%sK above target)", d1))
    )
    comfort = (
        F.when(
            cold & ~on,
            _action("turn_on", F.format_string("Too cold (%sK), unit=%s", d1, unit), unit=unit),
        )
        .when(cold & (raised != target), _action("adjust_target", too_cold, target, raised))
        .when(
            ~cold & warm & on & (lowered != target),
            _action("adjust_target", F.format_string("Too warm (%sK)", d1), target, lowered),
        )
    )
    load = F.when(
        (F.col("power") < r.low_power) & ~on & (delta < -0.5),
        _action("turn_on", F.format_string("Stability targeting (power=%sW)", fixed_text("power", 0)), unit=unit),
    )
    return F.when(night | hot, F.array_compact(F.array(turn_off))).otherwise(F.array_compact(F.array(comfort, load)))


def room_actions(rooms: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per action; ``action_no`` keeps the order of the rules within a room."""
    exploded = rooms.select("*", F.posexplode(room_decisions(rules)).alias("action_no", "_a"))
    return exploded.select(*rooms.columns, "action_no", *[F.col(f"_a.{f}").alias(f"a_{f}" if f in rooms.columns else f) for f in ACTION_FIELDS])


def cooldown_filter(rooms: DataFrame, actions: DataFrame, s: Series, rules: Rules = Rules(), emergency: str = "is_emergency") -> DataFrame:
    """Drop room rows whose last recorded action is too recent (less so in an emergency)."""
    log = actions.withColumn("last_action", F.col(s.ts))
    seen = asof_join(rooms, log, s, ["last_action"], strict=True)
    wait = F.when(F.col(emergency), rules.emergency_cooldown_minutes).otherwise(rules.cooldown_minutes)
    rested = F.coalesce(minutes_since(s.ts, "last_action") >= wait, F.lit(True))
    return seen.filter(rested).drop("last_action")


def cap_actions(actions: DataFrame, cycle: Sequence[str], max_actions: int = 2, room_order: str = "room", single_above: float | None = None) -> DataFrame:
    """Keep the actions of the largest deviations; earlier rooms win ties.

    With ``single_above`` a cycle whose total deviation exceeds it keeps one action only.
    """
    order = Window.partitionBy(*cycle).orderBy(F.desc(F.abs("delta")), room_order, "action_no")
    ranked = actions.withColumn("action_rank", F.row_number().over(order)).filter(F.col("action_rank") <= max_actions)
    if single_above is not None:
        ranked = ranked.filter((F.col("action_rank") == 1) | (F.col("total_delta_abs") <= single_above))
    return ranked


def gate_cycle(cycles: DataFrame) -> DataFrame:
    """A cycle in an unstable zone without an emergency waits."""
    emergency = flag(F.col("comfort_emergency")) | flag(F.col("stability_emergency"))
    return cycles.withColumns({"is_emergency": emergency, "gated": flag(F.col("in_unstable")) & ~emergency})


def reward(cycles: DataFrame, penalty: float = 20.0, watts_per_point: float = 500.0) -> DataFrame:
    """Comfort, stability and energy points; the penalty applies to gated cycles only."""
    comfort = -F.col("total_delta_abs")
    stability = F.when(F.col("gated"), -float(penalty)).otherwise(0.0)
    energy = -(F.col("power") / watts_per_point)
    return cycles.withColumns(
        {
            "reward_comfort": comfort,
            "reward_stability": stability,
            "reward_energy": energy,
            "reward_total": comfort + stability + energy,
        }
    )


def build_episodes(cycles: DataFrame, rooms: DataFrame, actions: DataFrame, keys: Sequence[str], zones: Column | None = None, units: DataFrame | None = None) -> DataFrame:
    """One nested record per cycle: state, actions, reward, zones and units.

    Rooms and actions are grouped per cycle, so a group is the few rooms of one site.
    """
    deltas = rooms.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("room").cast("string").alias("key"), F.col("delta").alias("value"))))).alias("_rooms")
    )
    entry = F.struct("action_rank", F.col("room").cast("string").alias("room"), *ACTION_FIELDS)
    taken = actions.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_actions"))
    out = cycles.join(deltas, list(keys), "left").join(taken, list(keys), "left")
    if units is not None:
        modes = units.groupBy(keys[0]).agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("unit_id").alias("key"), F.col("operating_mode").alias("value"))))).alias("outdoor_units")
        )
        out = out.join(modes, keys[0], "left")
    else:
        out = out.withColumn("outdoor_units", F.lit(None).cast("map<string,string>"))
    none = F.array().cast("array<struct<min: double, max: double>>")
    return out.select(
        *keys,
        F.struct("power", "outdoor_temp", "total_delta_abs", F.col("_rooms").alias("rooms")).alias("state"),
        F.coalesce(
            F.transform("_actions", lambda a: a.dropFields("action_rank")),
            F.array().cast("array<struct<room: string, action_type: string, old_target: double, new_target: double, reason: string, unit_id: string>>"),
        ).alias("actions"),
        F.struct(
            F.col("reward_total").alias("total"),
            F.col("reward_comfort").alias("comfort"),
            F.col("reward_stability").alias("stability"),
            F.col("reward_energy").alias("energy"),
        ).alias("reward"),
        (none if zones is None else zones).alias("unstable_zones"),
        "outdoor_units",
    )


def episode_stats(episodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return episodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg("reward.total").alias("avg_reward"),
        F.avg(F.size("actions")).alias("avg_actions"),
        F.avg("state.total_delta_abs").alias("avg_total_delta_abs"),
    )


def replay_policy(observed: DataFrame, comfort: Comfort = Comfort(), above: float = 0.6, high: float = 0.7) -> DataFrame:
    """Decisions for high-risk rows, with coarse std and spread inputs; no_action is dropped."""
    risky = observed.filter(F.col("cycling_risk") > above)
    worse = F.col("cycling_risk") > high
    coarse = risky.withColumns(
        {
            "power_std": F.when(worse, 100.0).otherwise(50.0),
            "power_spread": F.when(worse, 400.0).otherwise(200.0),
        }
    )
    return policy_v2(coarse, comfort).filter("action_type <> 'no_action'")
