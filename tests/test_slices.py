"""Sliced series give what one long series gives, wherever the cuts fall."""

import random

import naive
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import cycling, joins, observer, stats, windows
from wattloom.operators.windows import STATS
from wattloom.series import Series, fitted, sized, sliced, with_time

# lengths, or rows a slice is cut for
SLICES = ("2 minutes", 9, "1 day")


def series(seed, n):
    rng = random.Random(seed)
    level, out = 200.0, []
    for _ in range(n):
        if rng.random() < 0.3:
            level = rng.choice([0, 50, 120, 250, 400, 900, 1500])
        out.append(float(max(0, level + rng.randint(-60, 60))))
    return out


DATA = {k: series(k, n) for k, n in (("a", 120), ("b", 61), ("c", 3), ("d", 1))}


def by_key(df, *cols, order="ts"):
    out = {k: [] for k in DATA}
    for r in df.orderBy("entity_id", order).select("entity_id", *cols).collect():
        out[r[0]].append(r[1] if len(cols) == 1 else tuple(r[1:]))
    return out


@pytest.fixture(scope="module")
def df(minutes):
    return minutes(DATA).repartition(5).persist()


def described(df, slice_):
    """Slices of a constant length, or cut for a number of rows."""
    return Series(slice=slice_) if isinstance(slice_, str) else fitted(df, Series(), "3 minutes", slice_)


def idx(ts):
    return int(ts.timestamp() // 60) % 1440


@pytest.mark.parametrize("slice_", SLICES)
def test_cycles(df, slice_):
    s = described(df, slice_)
    got = by_key(cycling.detect_cycles(df, s, 300, 150), "start", "end", "peak_power", "avg_power", order="start")
    for k, values in DATA.items():
        want = naive.cycles(values, 300, 150)
        assert [(idx(a), idx(b), p, pytest.approx(m)) for a, b, p, m in got[k]] == want


@pytest.mark.parametrize("slice_", SLICES)
def test_fluctuations(df, slice_):
    s = described(df, slice_)
    found = cycling.detect_fluctuations(df, s, "10 minutes", 0.5)
    cols = ("start", "end", "instability_score", "amplitude_watts", "direction_changes", "avg_power")
    got = by_key(found, *cols, order="start")
    scores = by_key(cycling.instability_score(df, s, "10 minutes"), "score")
    for k, values in DATA.items():
        assert scores[k] == pytest.approx(naive.scores(values, 10))
        want = naive.fluctuations(values, 10, 0.5)
        assert [(idx(r[0]), idx(r[1])) for r in got[k]] == [w[:2] for w in want]
        assert [x for r in got[k] for x in r[2:]] == pytest.approx([x for w in want for x in w[2:]])


@pytest.mark.parametrize("slice_", SLICES)
def test_observer(df, slice_):
    got = by_key(observer.observer_risk(df, described(df, slice_)), "instability_score")
    for k, values in DATA.items():
        assert got[k] == pytest.approx(naive.risks(values))


@pytest.mark.parametrize("slice_", SLICES)
def test_runs(df, slice_):
    s = described(df, slice_)
    on = df.withColumn("on", F.col("value") > 200)
    got = by_key(windows.run_counter(on, s, "on"), "runtime")
    ids = by_key(windows.islands(on, s, "on"), "run_id")
    for k, values in DATA.items():
        flags = [v > 200 for v in values]
        assert got[k] == naive.runtimes(flags)
        changes = [1] + [int(a != b) for a, b in zip(flags, flags[1:])]
        assert ids[k] == [sum(changes[: i + 1]) for i in range(len(flags))]


@pytest.mark.parametrize("slice_", SLICES)
def test_row_and_time_frames(df, slice_):
    s = described(df, slice_)
    rolled = by_key(windows.rolling_rows(df, s, 7, stats=("mean", "min")), "roll_mean", "roll_min")
    timed = by_key(windows.rolling_time(df, s, "7 minutes", stats=("mean", "min")), "roll_mean", "roll_min")
    ahead = by_key(windows.forward_window(df, s, 10), "ahead_sum")
    for k, values in DATA.items():
        parts = [values[max(0, i - 6) : i + 1] for i in range(len(values))]
        want = [(pytest.approx(sum(p) / len(p)), min(p)) for p in parts]
        assert rolled[k] == want and timed[k] == want
        assert ahead[k] == pytest.approx([sum(values[i : i + 10]) for i in range(len(values))])
    assert set(STATS) == {"mean", "std", "min", "max"}


@pytest.mark.parametrize("slice_", SLICES)
def test_fills(df, slice_):
    s = described(df, slice_)
    gappy = df.withColumn("value", F.when(F.col("value") > 350, F.col("value")))
    forward, backward = by_key(windows.ffill(gappy, s, ["value"]), "value"), by_key(windows.bfill(gappy, s, ["value"]), "value")
    for k, values in DATA.items():
        known = [v if v > 350 else None for v in values]
        want_f = [next((x for x in reversed(known[: i + 1]) if x is not None), None) for i in range(len(known))]
        want_b = [next((x for x in known[i:] if x is not None), None) for i in range(len(known))]
        assert forward[k] == want_f and backward[k] == want_b


@pytest.mark.parametrize("slice_", SLICES)
def test_asof(df, slice_, minutes):
    s = described(df, slice_)
    left = df.filter(F.minute("ts") % 3 == 0).select("entity_id", "ts")
    right = df.filter(F.minute("ts") % 5 == 0).withColumnRenamed("value", "seen")
    for strict in (False, True):
        got = by_key(joins.asof_join(left, right, s, ["seen"], strict), "ts", "seen")
        for k, values in DATA.items():
            for ts, seen in got[k]:
                i = idx(ts) - int(strict)
                at = max((j for j in range(0, i + 1) if j % 60 % 5 == 0), default=None)
                assert seen == (None if at is None else values[at])


def test_slice_length_from_density(df):
    s = sized(df, Series(), target_rows=30)
    # the densest hour has 60 rows, so a slice of half an hour holds 30
    assert s.slice == "1800 seconds"


# -- slices cut by counted rows -----------------------------------------------------------
def slices(df, s):
    return {(r.entity_id, r._slice): r["count"] for r in sliced(df, s).groupBy("entity_id", "_slice").count().collect()}


def test_slices_grow_with_rows_and_follow_density(spark):
    """A burst of readings is cut into many slices; a quiet stretch of any length stays in one."""
    burst = [("a", 60 * 86_400 + i) for i in range(4000)]
    quiet = [("a", 3600 * i) for i in range(1000)] + [("b", 86_400 * i) for i in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in quiet + burst], "entity_id string, t long").select("entity_id", F.timestamp_seconds("t").alias("ts"))
    for target in (200, 1000):
        got = slices(df, fitted(df, Series(), "1 minute", target))
        assert sum(got.values()) == 5300 and max(got.values()) <= 1.5 * target
        assert len(got) <= 5300 / target * 1.5 + 4
        assert len([k for k, _ in got if k == "b"]) == -(-300 // target)
    whole = slices(df, fitted(df, Series(), "1 minute", 10_000))
    assert whole == {("a", 0): 5000, ("b", 0): 300}


def test_slices_are_no_shorter_than_the_frame(spark):
    df = spark.range(2000).select(F.lit("a").alias("entity_id"), F.timestamp_seconds("id").alias("ts"))
    s = fitted(df, Series(), "5 minutes", 10)
    near = with_time(df, s, back="5 minutes")
    assert near.groupBy("ts").count().agg(F.max("count")).first()[0] == 2
    spans = sliced(df, s).groupBy("_slice").agg((F.max("ts").cast("long") - F.min("ts").cast("long")).alias("n")).collect()
    assert all(r.n >= 299 for r in spans[:-1])


def test_series_that_the_cuts_do_not_know(spark, df):
    """New series, and moments before and after those that were counted."""
    s = fitted(df.filter("entity_id = 'a'").limit(40), Series(slice="7 minutes"), "2 minutes", 10)
    got = by_key(windows.rolling_rows(df, s, 5, stats=("mean",)), "roll_mean")
    for k, values in DATA.items():
        assert got[k] == pytest.approx([sum(values[max(0, i - 4) : i + 1]) / len(values[max(0, i - 4) : i + 1]) for i in range(len(values))])
    empty = fitted(df.limit(0), Series(slice="7 minutes"), "2 minutes", 10)
    assert windows.rolling_rows(df, empty, 5, stats=("mean",)).count() == df.count()


WINDOWED = ["rolling_time", "detect_cycles", "detect_fluctuations", "run_counter", "observer_risk", "asof_grid_join", "cooldown_filter", "causal_features"]


@pytest.mark.parametrize("target", [25, 200])
@pytest.mark.parametrize("name", WINDOWED)
def test_queries_in_slices_of_a_few_rows(spark, monkeypatch, name, target):
    """The registered queries agree with their SQL at two sizes of slices."""
    from oracle import compare, connect, fetch

    import __spark_entry__ as entry
    from wattloom import series

    monkeypatch.setattr(series, "TARGET_ROWS", target)
    folder = "/root/testdata/sf0.001"
    assert compare(entry.queries()[name](spark, folder).toArrow(), fetch(connect(folder), entry.oracle_sql()[name])) == ""


# -- parts of values ----------------------------------------------------------------------
def test_parts_of_values_are_even(spark, monkeypatch):
    """One outlier, a heavy value and a skewed range leave no part above twice the mean; quantiles stay exact."""
    monkeypatch.setattr(stats, "PART_VALUES", 100)
    rng = random.Random(4)
    values = [rng.random() ** 6 for _ in range(8000)] + [1e9, -1e9] + [0.5] * 3000
    rows = [("a", v) for v in values] + [("b", float(i % 7)) for i in range(50)] + [("b", None)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(5)
    counts = df.filter("v IS NOT NULL").groupBy("key", "v").count()
    parts = {(r.key, r.part): r["count"] for r in stats.value_parts(counts, ["key"], "v", "part").groupBy("key", "part").count().collect()}
    own = [n for (k, _), n in parts.items() if k == "a"]
    assert len(own) > stats.PARTS * 0.9 and max(own) <= 2 * sum(own) / len(own)
    assert [n for (k, _), n in parts.items() if k == "b"] == [7]
    got = {r.key: (r.lo, r.mid, r.hi) for r in stats.quantiles(df, ["key"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.999}).collect()}
    assert got["a"] == pytest.approx(tuple(np.quantile(values, [0.01, 0.5, 0.999])), rel=1e-12)
    assert got["b"] == pytest.approx(tuple(np.quantile([i % 7 for i in range(50)], [0.01, 0.5, 0.999])), rel=1e-12)
