"""Closed-loop replay against a plain loop, and against the open loop without cooldown."""

import datetime as dt
import random

import naive
import pytest
from conftest import rows
from pyspark.sql import functions as F

from wattloom.operators import policy
from wattloom.plans import control
from wattloom.series import Series

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def site(spark):
    rng = random.Random(3)
    rooms, cycles = [], []
    for site_id in (1, 2):
        for step in range(120):
            ts = T0 + dt.timedelta(minutes=5 * step)
            cycles.append((site_id, ts, float(rng.randint(200, 2000)), 5.0, rng.random() < 0.3))
            for room in "abcde":
                delta = rng.randint(-48, 48) / 16
                rooms.append((site_id, ts, room, delta, 21.0, rng.random() < 0.5, step % 40 > 30, "heat", "u"))
    r = spark.createDataFrame(rooms, "site_id long, ts timestamp, room string, delta double, target_temp double, is_on boolean, is_night boolean, operating_mode string, unit_id string")
    c = spark.createDataFrame(cycles, "site_id long, ts timestamp, power double, outdoor_temp double, stability_emergency boolean")
    return r.persist(), c.persist()


def zones(spark):
    return spark.createDataFrame([("unstable", 1000.0, 1500.0)], "kind string, power_min double, power_max double")


@pytest.mark.parametrize("slice_", ["15 minutes", "2 hours", "7 days"])
def test_closed_loop(spark, site, slice_):
    rooms, cycles = site
    rules = policy.Rules(cold=2.5, warm=2.5, cooldown_minutes=23.0, emergency_cooldown_minutes=11.0)
    s = Series(keys=("site_id",), slice=slice_)
    states = control.cycle_states(rooms, cycles, zones(spark), s, rules)
    got = control.closed_loop(rooms, states, s, rules)
    wanted = policy.room_actions(control.candidate_rooms(rooms, states, s), rules).collect()
    for site_id in (1, 2):
        plain = [
            (int((r.ts.timestamp() - T0.timestamp()) // 60) if r.ts.tzinfo else int((r.ts - T0.replace(tzinfo=None)).total_seconds() // 60), r.room, r.action_no, abs(r.delta), 11 if r.is_emergency else 23)
            for r in wanted
            if r.site_id == site_id
        ]
        want = naive.closed_loop(plain, rules.max_actions)
        found = got.filter(F.col("site_id") == site_id).collect()
        mine = sorted((int((r.ts - T0.replace(tzinfo=None)).total_seconds() // 60), r.room, r.action_no) for r in found)
        assert mine == want and want


def test_without_cooldown_both_loops_agree(spark, site):
    rooms, cycles = site
    rules = policy.Rules(cooldown_minutes=0.0, emergency_cooldown_minutes=0.0)
    s = Series(keys=("site_id",), slice="1 hour")
    states = control.cycle_states(rooms, cycles, None, s, rules)
    no_log = rooms.limit(0).select("site_id", "room", "ts")
    cols = ("site_id", "ts", "room", "action_no", "action_type", "new_target", "action_rank")
    order = ("site_id", "ts", "action_rank")
    open_ = control.open_loop(rooms, states, no_log, s, rules).select(*cols)
    closed = control.closed_loop(rooms, states, s, rules).select(*cols)
    assert rows(closed, *order) == rows(open_, *order)


def test_gated_cycles_take_no_action_and_are_penalised(spark, site):
    rooms, cycles = site
    rules = policy.Rules(cold=9.0, warm=9.0)
    s = Series(keys=("site_id",))
    states = control.cycle_states(rooms, cycles, zones(spark), s, rules).persist()
    gated = states.filter("gated")
    assert gated.count() == cycles.filter("power between 1000 and 1500 and not stability_emergency").count()
    assert {r[0] for r in gated.select("reward_stability").distinct().collect()} == {-20.0}
    assert control.candidate_rooms(rooms, states, s).join(gated, ["site_id", "ts"], "left_semi").count() == 0


def policy_row(spark, **over):
    row = {
        "power": 800.0, "cycling_risk": 0.1, "power_std": 10.0, "power_spread": 50.0, "min_stable_power": 450.0, "is_night": False,
        "units": [("x", False, None, 60), ("y", False, None, None), ("z", True, 21.0, 1)],
    } | over
    types = f"power double, cycling_risk double, power_std double, power_spread double, min_stable_power double, is_night boolean, units {policy.UNIT_SCHEMA}"
    return policy.policy_v2(spark.createDataFrame([tuple(row.values())], types)).first()


def test_unit_strategies(spark):
    assert policy_row(spark).action_type == "no_action"
    low = policy_row(spark, power=300.0)
    assert (low.strategy, low.target_unit, low.temperature, low.fan_mode) == ("stability", "y", 20.5, "auto")
    night = policy_row(spark, cycling_risk=0.9, is_night=True)
    assert (night.strategy, night.target_unit, night.temperature, night.fan_mode) == ("night", "y", 19.0, "low")
    # quiet at night: the ordinary strategy
    assert policy_row(spark, power=300.0, is_night=True).strategy == "stability"
    on = [("z", True, 21.0, 1)]
    nudge = policy_row(spark, power_std=60.0, units=on)
    assert (nudge.action_type, nudge.target_unit, nudge.temperature) == ("adjust_temp", "z", 21.3)
    down = policy_row(spark, power_std=60.0, units=[("z", True, 22.4, 1)])
    assert down.temperature == pytest.approx(22.1)
    assert policy_row(spark, power_std=60.0, units=[("z", True, 15.0, 1)]).temperature == pytest.approx(15.3)
    assert policy_row(spark, power_std=60.0, units=[]).action_type == "no_action"
    assert policy_row(spark, power=300.0, units=on).action_type == "no_action"


# -- zones by bucket ------------------------------------------------------------------
def test_zones_of_any_number_and_shape(spark):
    """Overlapping, touching, nested, point-like, very wide and broken zones, against looking at every one."""
    import random

    from wattloom.operators import joins

    rng = random.Random(5)
    zone_rows, power_rows = [], []
    for key in ("a", "b", "c"):
        for _ in range({"a": 300, "b": 3, "c": 1}[key]):
            lo = round(rng.uniform(-500, 3000), 1)
            zone_rows.append((key, "unstable", lo, lo + rng.choice([0.0, 0.5, 2.0, 40.0])))
        zone_rows.append((key, "stable", 0.0, 5000.0))
    zone_rows += [("a", "unstable", 1000.0, 1001.0), ("a", "unstable", 1001.0, 1001.5), ("b", "unstable", None, 9.0), ("b", "unstable", 9.0, 8.0), ("b", "unstable", -1e6, -9e5)]
    ends = [x for _, _, *z in zone_rows for x in z if x is not None]
    for key in ("a", "b", "c", "none"):
        power_rows += [(key, p) for p in [*rng.sample(ends, 60), *[rng.uniform(-600, 3200) for _ in range(200)], None, float("nan"), 1e12, -1e12]]
    df = spark.createDataFrame(power_rows, "key string, value double").repartition(3)
    zones_ = spark.createDataFrame(zone_rows, "key string, kind string, power_min double, power_max double")

    def hit(p, mine):
        return p is not None and any(lo is not None and lo <= p <= hi for _, kind, lo, hi in mine if kind == "unstable")

    own = joins.zone_range_join(df, zones_, ["key"]).collect()
    every = joins.zone_range_join(df, zones_, out="hit").collect()
    assert len(own) == len(every) == len(power_rows)
    assert all(r.in_unstable == hit(r.value, [z for z in zone_rows if z[0] == r.key]) for r in own)
    assert all(r.hit == hit(r.value, zone_rows) for r in every)
    none = joins.zone_range_join(df, zones_.limit(0)).collect()
    assert len(none) == len(power_rows) and not any(r.in_unstable for r in none)


def test_the_index_grows_with_the_ranges_only(spark):
    from wattloom.operators import joins

    many = spark.range(2000).select(F.lit("unstable").alias("kind"), (F.col("id") * 10.0).alias("power_min"), (F.col("id") * 10.0 + 4).alias("power_max"))
    assert joins.disjoint_ranges(many).count() == 2000
    df = spark.range(5000).select((F.col("id") * 4.0).alias("value"))
    assert joins.zone_range_join(df, many).filter("in_unstable").count() == sum((4 * i) % 10 <= 4 and 4 * i < 20_000 for i in range(5000))
