"""Compressor cycles, fluctuation periods, power jumps and episodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.scalar import clip, cycling_risk_additive
from wattloom.operators.grids import fill_grid
from wattloom.operators.windows import over_time, rolling_columns, with_direction_changes
from wattloom.series import ORD, Series, home, micros, plain, running, with_neighbours


def minutes(start: Column | str, end: Column | str) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return (end - start) / F.lit(60e6)


def marker(value: Column | str, on: float, off: float) -> Column:
    """1 above ``on``, 0 below ``off``, NULL in between: the state is the last marker."""
    if off > on:
        raise ValueError("the off threshold must not exceed the on threshold")
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value > on, 1).when(value < off, 0)


def hysteresis_state(df: DataFrame, s: Series, on: float = 200.0, off: float = 100.0, out: str = "state") -> DataFrame:
    """On/off state with two thresholds; starts off unless the first value is above ``on``."""
    held = running(df, s, last={out: marker(s.value, on, off)})
    return plain(held.withColumn(out, F.coalesce(out, F.lit(0))))


def detect_cycles(df: DataFrame, s: Series, on: float = 200.0, off: float = 100.0) -> DataFrame:
    """Finished on/off cycles; the off row belongs to the cycle.

    A run that is on from the first row of the series, and a last run without an off row,
    are left out.  Each cycle is the rows from the first marker 1 after a marker 0 up to
    the next marker 0, so one carried pass and one partially aggregated groupBy suffice.
    """
    m = marker(s.value, on, off)
    held = running(
        df,
        s,
        last={"_state": m},
        prior={"_seg": F.when(m == 0, F.col(ORD)), "_was": m},
        sums={"_no": F.lit(1).cast("long")},
    )
    begins = (F.col("_state") == 1) & (F.coalesce("_was", F.lit(0)) == 0)
    ends = (F.col("_state") == 0) & (F.col("_was") == 1)
    rows = held.filter((F.col("_state") == 1) | ends)
    cycles = rows.groupBy(*s.keys, "_seg").agg(
        F.min(F.when(begins & (F.col("_no") > 1), F.col(ORD))).alias("_start"),
        F.max(F.when(ends, F.col(ORD))).alias("_end"),
        F.max(s.value).alias("peak_power"),
        F.avg(s.value).alias("avg_power"),
        F.count(F.lit(1)).alias("rows"),
    )
    return cycles.filter("_start is not null and _end is not null").select(
        *s.keys,
        F.timestamp_micros("_start").alias("start"),
        F.timestamp_micros("_end").alias("end"),
        minutes("_start", "_end").alias("duration_minutes"),
        "peak_power",
        "avg_power",
        "rows",
    )


def short_cycles(cycles: DataFrame, limit_minutes: float = 10.0) -> DataFrame:
    return cycles.filter(F.col("duration_minutes") < limit_minutes)


def _scored(df: DataFrame, s: Series, width: str, weights: tuple[float, float, float]) -> DataFrame:
    """Rows with their slices, sign, turn, next_sign, next_turn and score."""
    near = with_direction_changes(df, s).withColumns(
        {"next_sign": F.lead("sign").over(s.window), "next_turn": F.lead("turn").over(s.window)}
    )
    near = home(near)
    frames = {"_mean": ("mean", s.value), "_std": ("std", s.value), "_low": ("min", s.value), "_high": ("max", s.value), "_turns": ("mean", "turn")}
    stats = over_time(near, s, back=frames, reach=micros(width) - 1).withColumn("_swing", F.col("_high") - F.col("_low"))
    w_std, w_swing, w_turn = weights
    parts = [
        w * F.coalesce(F.try_divide(F.col(c), "_mean"), F.lit(0.0))
        for w, c in ((w_std, "_std"), (w_swing, "_swing"))
    ]
    blend = reduce(Column.__add__, parts) + w_turn * F.coalesce("_turns", F.lit(0.0))
    # a spread around a zero mean counts as unbounded
    unbounded = (F.col("_mean") == 0) & ((F.col("_std") > 0) | (F.col("_swing") > 0))
    stats = stats.withColumn("score", F.when(unbounded, 1.0).otherwise(clip(blend, 0, 1)))
    return stats.drop("_mean", "_std", "_low", "_high", "_swing", "_turns")


SCORE_WEIGHTS = (0.4, 0.4, 2.0)


def instability_score(df: DataFrame, s: Series, width: str = "10 minutes", weights: tuple[float, float, float] = SCORE_WEIGHTS) -> DataFrame:
    """0-1 score from relative spread, relative swing and direction changes in (t - width, t]."""
    return plain(_scored(df, s, width, weights).drop("sign", "turn", "next_sign", "next_turn"))


def _fluctuation_groups(df: DataFrame, s: Series, width: str, threshold: float, weights: tuple[float, float, float]) -> DataFrame:
    """One row per run of unstable rows with the row after it, and one for all other rows.

    ``_seg`` is the position of the last stable row before a row, so the rows of a run and
    its closing row share it.  Every reading is in exactly one group.
    """
    scored = _scored(df, s, width, weights)
    unstable = F.col("score") > threshold
    tagged = running(scored, s, prior={"_seg": F.when(~unstable, F.col(ORD)), "_was": unstable})
    tagged = tagged.withColumn("_event", unstable | F.coalesce("_was", F.lit(False)))
    return tagged.groupBy(*s.keys, "_event", F.when(F.col("_event"), F.col("_seg")).alias("_seg")).agg(
        F.min(ORD).alias("_start"),
        F.max(ORD).alias("_end"),
        F.sum("score").alias("_score"),
        F.max("score").alias("_top"),
        F.min(s.value).alias("_low"),
        F.max(s.value).alias("_high"),
        F.avg(s.value).alias("avg_power"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("turn").alias("_turns"),
        F.min_by(F.struct("turn", "next_sign", "next_turn"), ORD).alias("_first"),
    )


def detect_fluctuations(
    df: DataFrame,
    s: Series,
    width: str = "10 minutes",
    threshold: float = 0.5,
    weights: tuple[float, float, float] = SCORE_WEIGHTS,
) -> DataFrame:
    """Periods with a score above the threshold, including the first row after each.

    Direction changes count as if the period stood alone: its first row has sign 0.  So the
    changes of the first two rows are replaced by "is the second sign non-zero", which the
    first row knows from its successor - no window over a whole period is needed.
    """
    events = _fluctuation_groups(df, s, width, threshold, weights).filter("_event and rows >= 2")
    own = F.col("_turns") - F.col("_first.turn") - F.col("_first.next_turn")
    events = events.withColumns(
        {
            "duration_minutes": minutes("_start", "_end"),
            "direction_changes": own + (F.col("_first.next_sign") != 0).cast("int"),
        }
    )
    per = F.when(F.col("duration_minutes") > 0, F.col("duration_minutes")).otherwise(1.0)
    return events.select(
        *s.keys,
        F.timestamp_micros("_start").alias("start"),
        F.timestamp_micros("_end").alias("end"),
        "duration_minutes",
        (F.col("_score") / F.col("rows")).alias("instability_score"),
        (F.col("_high") - F.col("_low")).alias("amplitude_watts"),
        "direction_changes",
        (F.col("direction_changes") / per).alias("frequency"),
        "avg_power",
        "rows",
    )


def detect_power_jumps(df: DataFrame, s: Series, watts: float = 300.0, pct: float = 40.0) -> DataFrame:
    """Steps of at least ``watts``, or of at least ``pct`` percent of a positive previous value."""
    near = with_neighbours(df, s, back=1).withColumn("power_before", F.lag(s.value).over(s.window))
    delta = F.col(s.value) - F.col("power_before")
    share = F.when(F.col("power_before") > 0, F.abs(delta) / F.col("power_before") * 100)
    hit = (F.abs(delta) >= watts) | F.coalesce(share >= pct, F.lit(False))
    return plain(near.filter(hit)).select(
        *s.keys,
        s.ts,
        "power_before",
        F.col(s.value).alias("power_after"),
        delta.alias("delta_watts"),
        share.alias("delta_pct"),
    )


def analyze_cycling(
    df: DataFrame,
    s: Series,
    on: float = 200.0,
    off: float = 100.0,
    jump_watts: float = 300.0,
    jump_pct: float = 40.0,
    width: str = "10 minutes",
    threshold: float = 0.5,
    short_minutes: float = 10.0,
) -> DataFrame:
    """One row per series with the totals of the detectors above."""
    us = F.unix_micros(s.ts)
    span = df.groupBy(*s.keys).agg(((F.max(us) - F.min(us)) / F.lit(3600e6)).alias("time_span_hours"))
    cycles = detect_cycles(df, s, on, off).groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("total_cycles"),
        F.count_if(F.col("duration_minutes") < short_minutes).alias("short_cycle_count"),
        F.avg("duration_minutes").alias("avg_cycle_duration"),
    )
    # the groups hold every reading once, so they give the score statistics, too
    fluctuations = _fluctuation_groups(df, s, width, threshold, SCORE_WEIGHTS).groupBy(*s.keys).agg(
        (F.sum("_score") / F.sum("rows")).alias("avg_instability"),
        F.max("_top").alias("max_instability"),
        F.count_if(F.col("_event") & (F.col("rows") >= 2)).alias("fluctuation_count"),
    )
    jumps = detect_power_jumps(df, s, jump_watts, jump_pct).groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("jump_count")
    )
    # one row per series on every side
    joined = span
    for part in (cycles, fluctuations, jumps):
        joined = joined.join(part, list(s.keys), "left")
    counts = ("total_cycles", "short_cycle_count", "fluctuation_count", "jump_count")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    rate = F.when(F.col("time_span_hours") > 0, F.col("total_cycles") / F.col("time_span_hours"))
    return joined.withColumn("cycles_per_hour", F.coalesce(rate, F.lit(0.0)))


def find_cycling_periods(cycles: DataFrame, s: Series, bucket: str = "1 hour", per_hour: float = 4.0) -> DataFrame:
    """Cycle starts per calendar bucket, zero-filled between the first and the last."""
    counted = cycles.groupBy(*s.keys, F.window("start", bucket).start.alias("bucket")).agg(
        F.count(F.lit(1)).alias("cycles")
    )
    hours = micros(bucket) / 3600e6
    filled = fill_grid(counted, s.keys, "bucket", bucket)
    rate = F.coalesce("cycles", F.lit(0)) / F.lit(hours)
    return filled.select(
        *s.keys, "bucket", rate.alias("cycles_per_hour"), (rate > per_hour).alias("is_problematic")
    )


def runs_where(df: DataFrame, s: Series, condition: Column, aggs: list[Column]) -> DataFrame:
    """Aggregate every uninterrupted run of rows that meet the condition."""
    holds = F.coalesce(condition, F.lit(False))
    tagged = running(df, s, prior={"_seg": F.when(~holds, F.col(ORD))})
    runs = tagged.filter(holds).groupBy(*s.keys, "_seg").agg(*aggs)
    return runs.drop("_seg")


def with_additive_risk(df: DataFrame, s: Series, n: int = 5, scale: float = 1.0) -> DataFrame:
    """Rolling std and spread over n rows and the 0-100 risk; keeps the slices."""
    near = with_neighbours(df, s, back=n - 1).withColumns(
        rolling_columns(s, n, "power", ("std", "min", "max"))
    )
    near = home(near).withColumn("power_spread", F.col("power_max") - F.col("power_min"))
    return near.withColumn("cycling_risk", cycling_risk_additive("power_std", "power_spread", scale))


def _episode_aggs(s: Series) -> list[Column]:
    v = s.value
    return [
        F.timestamp_micros(F.min(ORD)).alias("start"),
        F.timestamp_micros(F.max(ORD)).alias("end"),
        F.min(v).alias("power_min"),
        F.max(v).alias("power_max"),
        F.avg(v).alias("power_mean"),
        F.stddev_samp(v).alias("power_std"),
        F.count(F.lit(1)).alias("rows"),
    ]


def cycling_episodes(df: DataFrame, s: Series, n: int = 5, above: float = 70.0, min_rows: int = 5, scale: float = 1.0) -> DataFrame:
    """Runs of more than ``min_rows`` rows with a risk above the limit."""
    risky = with_additive_risk(df, s, n, scale)
    runs = runs_where(risky, s, F.col("cycling_risk") > above, _episode_aggs(s))
    return runs.filter(F.col("rows") > min_rows)


def stable_episodes(df: DataFrame, s: Series, n: int = 5, below: float = 30.0, min_rows: int = 10, low_power: float = 600.0, scale: float = 1.0) -> DataFrame:
    """Runs of more than ``min_rows`` rows with a risk below the limit."""
    risky = with_additive_risk(df, s, n, scale)
    runs = runs_where(risky, s, F.col("cycling_risk") < below, _episode_aggs(s))
    return runs.filter(F.col("rows") > min_rows).withColumn("low_power", F.col("power_mean") < low_power)


def episode_summary(episodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """How many episodes, their mean length, spread, power and std."""
    return episodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.avg("rows").alias("avg_rows"),
        F.avg(F.col("power_max") - F.col("power_min")).alias("avg_spread"),
        F.avg("power_mean").alias("avg_power"),
        F.avg("power_std").alias("avg_std"),
    )
