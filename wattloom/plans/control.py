"""The control cycle replayed over past states."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.operators import policy as p
from wattloom.operators.joins import zone_range_join
from wattloom.operators.stats import comfort_emergency
from wattloom.series import SLICE, Series, micros
from wattloom.session import checkpoint_dir


def cycle_states(rooms: DataFrame, cycles: DataFrame, zones: DataFrame | None, s: Series, rules: p.Rules = p.Rules(), zone_keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per cycle: total deviation, emergencies, zone, gate and reward.

    ``rooms`` has (site, ts, room, delta), ``cycles`` (site, ts, power, outdoor_temp,
    stability_emergency).
    """
    cycle = [*s.keys, s.ts]
    comfort = comfort_emergency(rooms, cycle, rules.cold, rules.warm).drop("offending_rooms")
    out = cycles.join(p.total_delta_abs(rooms, cycle), cycle, "left").join(comfort, cycle, "left")
    out = out.withColumn("total_delta_abs", F.coalesce("total_delta_abs", F.lit(0.0)))
    if zones is None:
        out = out.withColumn("in_unstable", F.lit(False))
    else:
        out = zone_range_join(out, zones, zone_keys, "power")
    return p.reward(p.gate_cycle(out))


def candidate_rooms(rooms: DataFrame, states: DataFrame, s: Series) -> DataFrame:
    """Room rows of the cycles that decide, with the power and the emergency of the cycle."""
    cycle = [*s.keys, s.ts]
    return rooms.join(states.filter(~F.col("gated")).select(*cycle, "power", "is_emergency", "total_delta_abs"), cycle)


def open_loop(rooms: DataFrame, states: DataFrame, log: DataFrame, s: Series, rules: p.Rules = p.Rules()) -> DataFrame:
    """Actions the rules would take, with the cooldown given by the recorded actions."""
    at_room = replace(s, keys=(*s.keys, "room"))
    ready = p.cooldown_filter(candidate_rooms(rooms, states, s), log, at_room, rules)
    return p.cap_actions(p.room_actions(ready, rules), [*s.keys, s.ts], rules.max_actions)


def _simulate(rows: pd.DataFrame, last: dict[str, int], max_actions: int) -> tuple[pd.DataFrame, dict[str, int]]:
    """Take the wanted actions cycle by cycle; ``last`` is the last action time per room."""
    taken = []
    for now, cycle in rows.sort_values(["_us", "room", "action_no"]).groupby("_us", sort=True):
        waited = cycle["room"].map(lambda room: now - last[room] if room in last else None)
        ready = cycle[waited.isna() | (waited >= cycle["_wait"])]
        ready = ready.assign(_size=ready["delta"].abs()).sort_values("_size", ascending=False, kind="stable")
        ready = ready.head(max_actions)
        last.update(dict.fromkeys(ready["room"], now))
        taken.append(ready.drop(columns="_size").assign(action_rank=range(1, len(ready) + 1)))
    return pd.concat(taken), last


def closed_loop(rooms: DataFrame, states: DataFrame, s: Series, rules: p.Rules = p.Rules()) -> DataFrame:
    """Actions the rules would take if the cooldown follows from the actions themselves.

    The actions a room wants do not depend on the cooldown, so they are found by the same
    expressions as in the open loop; only cooldown and cap run in time order.  They run per
    site and time slice.  All that passes from one slice to the next is which rooms acted
    shortly before its end: every slice is first run without it, and slices whose start
    turns out differently are run again until nothing changes.  At least one more slice per
    site is final after each round, so the result is that of one long run.
    """
    checkpoint_dir(rooms.sparkSession)
    keys, cols = list(s.keys), [*s.keys, s.ts, "room", "delta", "action_no", *p.ACTION_FIELDS]
    size = micros(s.slice)
    wait = F.when(F.col("is_emergency"), rules.emergency_cooldown_minutes).otherwise(rules.cooldown_minutes)
    wanted = p.room_actions(candidate_rooms(rooms, states, s), rules)
    wanted = wanted.withColumns({"_us": F.unix_micros(s.ts), "_wait": (wait * 60e6).cast("long")})
    wanted = wanted.withColumn(SLICE, F.expr(f"_us div {size}"))
    wanted = wanted.select(*cols, "_us", "_wait", SLICE).checkpoint()
    longest = int(max(rules.cooldown_minutes, rules.emergency_cooldown_minutes) * 60e6)
    recent = "array<struct<room: string, at: long>>"
    key_types = ", ".join(f"{k} {wanted.schema[k].dataType.simpleString()}" for k in keys)

    def start_of(pdf: pd.DataFrame) -> dict[str, int]:
        held = pdf["_start"].iloc[0]
        return {r["room"]: r["at"] for r in held} if held is not None else {}

    def leave(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start = start_of(pdf)
        _, last = _simulate(pdf, start, rules.max_actions)
        end = (key[-1] + 1) * size
        held = sorted((r, int(at)) for r, at in last.items() if end - at < longest)
        return pd.DataFrame([[*key, [{"room": r, "at": at} for r, at in held]]], columns=[*keys, SLICE, "_end"])

    def act(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _simulate(pdf, start_of(pdf), rules.max_actions)[0][[*cols, "action_rank"]]

    nobody = F.array().cast(recent)
    starts = wanted.select(*keys, SLICE).distinct().withColumn("_start", nobody).checkpoint()
    todo, ends = starts, None
    while True:
        run = wanted.join(todo, [*keys, SLICE]).groupBy(*keys, SLICE)
        fresh = run.applyInPandas(leave, f"{key_types}, {SLICE} long, _end {recent}")
        if ends is not None:
            fresh = fresh.unionByName(ends.join(todo.select(*keys, SLICE), [*keys, SLICE], "left_anti"))
        ends = fresh.checkpoint()
        # what the slice before left, less what is out of reach by now
        before = Window.partitionBy(*keys).orderBy(SLICE)
        left = ends.withColumn("_left", F.lag("_end").over(before))
        reach = F.filter(F.coalesce("_left", nobody), lambda r: F.col(SLICE) * size - r["at"] < longest)
        new = left.select(*keys, SLICE, reach.alias("_new")).join(starts, [*keys, SLICE])
        new = new.withColumn("_changed", F.col("_new") != F.col("_start")).checkpoint()
        starts = new.select(*keys, SLICE, F.col("_new").alias("_start"))
        todo = new.filter("_changed").select(*keys, SLICE, F.col("_new").alias("_start"))
        if todo.isEmpty():
            break
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.select(*cols).schema)
    return wanted.join(starts, [*keys, SLICE]).groupBy(*keys, SLICE).applyInPandas(act, f"{fields}, action_rank long")


def episodes(rooms: DataFrame, states: DataFrame, actions: DataFrame, s: Series, zones: Column | None = None, units: DataFrame | None = None) -> DataFrame:
    """One nested record per cycle."""
    return p.build_episodes(states, rooms, actions, [*s.keys, s.ts], zones, units)
