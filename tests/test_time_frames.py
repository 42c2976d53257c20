"""Time frames cost the same a row whatever they hold, and hold the same rows as before."""

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from wattloom.operators import cycling, joins, windows
from wattloom.series import Series

S = Series()


@pytest.fixture(scope="module")
def odd(spark):
    """Two series with repeated moments, missing values and a missing time; a missing key is a series, too."""
    rng = random.Random(7)
    rows = [(k, rng.randrange(0, 4000) * 250_000, rng.choice([None, rng.uniform(-900, 900), 250.1])) for k in ("a", "b", None) for _ in range(300)]
    rows += rows[:40] + [("a", None, 5.0), ("a", None, 8.5)]
    df = spark.createDataFrame(rows, "entity_id string, us long, value double")
    return df.select("entity_id", F.timestamp_micros("us").alias("ts"), "value"), rows


def sliding(df):
    """Frames of the plan that begin at an offset: each row of these is aggregated anew."""
    return re.findall(r"specifiedwindowframe\(RangeFrame, -?\d[^)]*\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("width", ["90 seconds", "20 minutes"])
def test_rolling_time_of_odd_rows(odd, width):
    df, rows = odd
    span = int(width.split()[0]) * (1_000_000 if "second" in width else 60_000_000)
    got = windows.rolling_time(df, S, width).withColumn("us", F.unix_micros("ts")).collect()
    assert len(got) == len(rows)
    for r in got:
        # rows without a time are in each other's frames
        held = [v for k, u, v in rows if k == r.entity_id and v is not None and (u is r.us is None or None not in (u, r.us) and r.us - span < u <= r.us)]
        want = (statistics.fmean(held), statistics.stdev(held) if len(held) > 1 else None, min(held), max(held)) if held else (None,) * 4
        for x, y in zip((r.roll_mean, r.roll_std, r.roll_min, r.roll_max), want):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6))


def test_rolling_time_frames(odd):
    assert sliding(windows.rolling_time(odd[0], S, "90 seconds")) == []


def test_score_frames(odd):
    assert sliding(cycling.instability_score(odd[0], S, "90 seconds")) == []
    assert sliding(cycling.detect_fluctuations(odd[0], S, "90 seconds")) == []


def test_event_window_of_odd_rows(odd):
    df, rows = odd
    event = F.col("value") > 600
    found = joins.event_window(df, S, event, ["value"], "90 seconds")
    assert sliding(found) == []
    got = found.withColumn("us", F.unix_micros("ts")).collect()
    assert len(got) == sum(v is not None and v > 600 for _, _, v in rows) > 20
    for r in got:
        own = [(u, v) for k, u, v in rows if k == r.entity_id and None not in (u, v)]
        assert r.value_before == pytest.approx(statistics.fmean(v for u, v in own if r.us - 90_000_000 <= u <= r.us))
        assert r.value_after == pytest.approx(statistics.fmean(v for u, v in own if r.us <= u <= r.us + 90_000_000))
