"""Literal rows with answers worked out by hand."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wattloom.operators import cycling, features, observer, policy, stats, windows, zones
from wattloom.operators.scan import MEASUREMENTS
from wattloom.series import Series

S = Series(slice="2 minutes")
T0 = dt.datetime(2024, 1, 1)


def at(m):
    return T0 + dt.timedelta(minutes=m)


def minute(ts):
    return int((ts.replace(tzinfo=None) - T0).total_seconds() // 60)


def test_hysteresis_and_cycle(minutes):
    df = minutes({"a": [100, 400, 200, 120, 500, 500]})
    got = rows(cycling.hysteresis_state(df, S, 300, 150).select("ts", "state"), "ts")
    assert [r[1] for r in got] == [0, 1, 1, 0, 1, 1]
    (c,) = cycling.detect_cycles(df, S, 300, 150).collect()
    assert (minute(c.start), minute(c.end), c.duration_minutes, c.peak_power, c.avg_power) == (1, 3, 2.0, 400, 240)


def test_leading_run_is_left_out(minutes):
    df = minutes({"a": [400, 400, 100, 100, 400, 100]})
    (c,) = cycling.detect_cycles(df, S, 300, 150).collect()
    assert (minute(c.start), minute(c.end), c.duration_minutes, c.peak_power, c.avg_power) == (4, 5, 1.0, 400, 250)


def test_off_threshold_above_on_is_refused(minutes):
    with pytest.raises(ValueError):
        cycling.detect_cycles(minutes({"a": [1, 2]}), S, 100, 150)


def test_time_window_is_open_on_the_left(minutes):
    df = minutes({"a": [1, 2, 4]}, step=600)
    got = windows.rolling_time(df, S, "10 minutes", stats=("mean",))
    assert [r[0] for r in got.orderBy("ts").select("roll_mean").collect()] == [1, 2, 4]


def test_jumps(minutes):
    df = minutes({"a": [500, 510, 1000, 1010, 500]})
    got = rows(cycling.detect_power_jumps(df, S).select("ts", "delta_watts"), "ts")
    assert [(minute(t), d) for t, d in got] == [(2, 490), (4, -510)]


def test_forward_label(minutes):
    df = minutes({"a": [0] * 11 + [1] + [0] * 8})
    got = features.predictor_labels(df, S, change="value")
    assert [r[0] for r in got.orderBy("ts").select("label").collect()] == [0, 0] + [1] * 10 + [0] * 8


def test_runtime(minutes):
    df = minutes({"a": [1, 1, 0, 1, 1, 1, 0]}).withColumn("on", F.col("value") > 0)
    got = windows.run_counter(df, S, "on").orderBy("ts").select("runtime").collect()
    assert [r[0] for r in got] == [1, 2, 0, 1, 2, 3, 0]


def test_exclusive_window(minutes):
    got = windows.trailing_exclusive(minutes({"a": [100] * 31}), S).collect()
    assert [(r.power_mean, r.power_std) for r in got] == [(100, 0)]


def room_rows(spark, data):
    names = "room string, delta double, target_temp double, is_on boolean, power double, is_night boolean"
    df = spark.createDataFrame(data, names)
    return df.withColumns({"operating_mode": F.lit("heat"), "unit_id": F.lit("u"), "cycle": F.lit(0)})


def test_room_rules(spark):
    df = room_rows(
        spark,
        [
            ("cold_off", -2.0, 21.0, False, 400.0, False),
            ("at_max", -2.0, 24.0, True, 900.0, False),
            ("hot", 2.5, 21.0, True, 900.0, False),
            ("warm", 1.5, 21.0, True, 900.0, False),
            ("night", -0.4, 21.0, True, 900.0, True),
        ],
    )
    got = policy.room_actions(df).select("room", "action_no", "action_type", "new_target")
    assert rows(got, "room", "action_no") == [
        ("cold_off", 0, "turn_on", None),
        ("cold_off", 1, "turn_on", None),
        ("hot", 0, "turn_off", None),
        ("night", 0, "turn_off", None),
        ("warm", 0, "adjust_target", 20.5),
    ]


def test_reason_rounds_halves_to_even(spark):
    df = room_rows(spark, [("a", 2.25, 21.0, True, 900.0, False), ("b", -1.75, 21.0, False, 512.5, False)])
    got = rows(policy.room_actions(df).select("room", "reason"), "room")
    assert got == [("a", "Overheating (2.2K above target)"), ("b", "Too cold (-1.8K), unit=u")]


def test_cap_keeps_the_largest(spark):
    df = room_rows(spark, [("a", -2.0, 21.0, False, 900.0, False), ("b", 1.2, 21.0, True, 900.0, False), ("c", -3.0, 21.0, False, 900.0, False)])
    got = policy.cap_actions(policy.room_actions(df), ["cycle"], 2)
    assert rows(got.select("action_rank", "room"), "action_rank") == [(1, "c"), (2, "a")]


def test_reward(spark):
    df = spark.createDataFrame([(3.2, 850.0, True)], "total_delta_abs double, power double, gated boolean")
    assert policy.reward(df).first().reward_total == pytest.approx(-24.9)


def test_region_score(spark):
    df = spark.createDataFrame([("r", 500.0, 40.0, int(i == 0)) for i in range(600)], "region string, value double, power_std double, power_jump int")
    got = zones.region_summary(df, ["region"], full_rate=12.0).first()
    # 1 jump in 600 rows: 0.1 per hour
    assert got.jump_rate == pytest.approx(0.1)
    assert got.stability_score == pytest.approx(0.8 * 0.6 + 0.2 * (1 - 0.1 / 12))


def test_min_stable_power_fallbacks(spark):
    cols = "k string, power_min double, power_max double, stability_score double"
    df = spark.createDataFrame(
        [("a", 600.0, 800.0, 0.9), ("a", 400.0, 500.0, 0.7), ("b", 350.0, 380.0, 0.5), ("b", 500.0, 700.0, 0.3), ("c", 10.0, 200.0, 0.9)], cols
    )
    every = spark.createDataFrame([(k,) for k in "abcd"], "k string")
    got = dict(rows(zones.min_stable_power(df, ["k"], every), "k"))
    assert got == {"a": 400, "b": 400, "c": 450, "d": 450}


def test_observer_first_readings_and_oscillation(minutes):
    df = minutes({"a": [400, 800] * 10}, step=30)
    got = [r[0] for r in observer.observer_risk(df, S).orderBy("ts").select("instability_score").collect()]
    assert got[:4] == [0, 0, 0, 0]
    # 20 readings: pop-std 200, spread 400, 19 steps
    assert got[-1] == pytest.approx(min(1.0, 0.4 * 200 / 125 + 0.4 * 400 / 1000 + 0.2 * 19 / 10))
    ten = [r[0] for r in observer.observer_risk(df.limit(20), S).orderBy("ts").select("instability_score").collect()][9]
    assert ten == pytest.approx(0.64 + 0.16 + 0.18)


def test_total_power(spark):
    units = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "site_id long, unit_id string")
    readings = spark.createDataFrame(
        [(1, "a", T0, "100"), (1, "b", T0, "50"), (1, "b", at(1), "unavailable"), (2, "c", T0, "unknown"), (3, "d", T0, "7.5")],
        "site_id long, unit_id string, ts timestamp, state string",
    )
    got = dict((r[0], r[2]) for r in rows(stats.total_power(readings, units), "site_id"))
    assert got == {1: 100.0, 2: None, 3: 7.5}


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 7.0)], "k string, v double")
    got = rows(stats.quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}), "k")
    assert got[0] == ("a", 1.75, 2.5, pytest.approx(3.7))
    assert got[1] == ("b", 7, 7, 7)


def test_fixed_order_of_measurements():
    assert MEASUREMENTS[0] == "W" and MEASUREMENTS[-1] == " "
