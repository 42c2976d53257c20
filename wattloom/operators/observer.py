"""Cycling risk as each new reading would have shown it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.scalar import clip, dashboard_round
from wattloom.series import Series, home, plain, with_neighbours

HISTORY = 20
FIRST = 5


def risk_score(std: Column, spread: Column, jumps: Column) -> Column:
    return clip(0.4 * (std / 125.0) + 0.4 * (spread / 1000.0) + 0.2 * (jumps / 10.0), 0, 1)


def _observed(df: DataFrame, s: Series, jump: float) -> DataFrame:
    frame = s.window.rowsBetween(-(HISTORY - 1), 0)
    steps = s.window.rowsBetween(-(HISTORY - 2), 0)
    near = with_neighbours(df, s, back=HISTORY - 1)
    near = near.withColumn("_delta", F.abs(F.col(s.value) - F.lag(s.value).over(s.window)))
    near = near.withColumn("_jump", F.coalesce((F.col("_delta") > jump).cast("int"), F.lit(0)))
    score = risk_score(
        F.stddev_pop(s.value).over(frame),
        F.max(s.value).over(frame) - F.min(s.value).over(frame),
        F.sum("_jump").over(steps),
    )
    # a slice starts with up to 19 neighbours, so the frame count tells the first rows
    enough = F.count(F.lit(1)).over(frame) >= FIRST
    return near.withColumns(
        {"_enough": enough, "instability_score": F.when(enough, score).otherwise(0.0)}
    )


def observer_risk(df: DataFrame, s: Series, jump: float = 200.0, cycling: float = 0.6) -> DataFrame:
    """Score over the last 20 readings, 0 before the fifth; the risk is the rounded score."""
    near = _observed(df, s, jump).drop("_delta", "_jump", "_enough")
    return plain(near).withColumns(
        {
            "cycling_risk": dashboard_round("instability_score", 2),
            "is_cycling": F.col("instability_score") > cycling,
        }
    )


def recent_jumps(df: DataFrame, s: Series, n: int = 10, jump: float = 200.0) -> DataFrame:
    """The newest n large steps of each series, as absolute deltas."""
    hits = home(_observed(df, s, jump)).filter("_enough and _jump = 1")
    newest = Window.partitionBy(*s.keys).orderBy(F.desc(s.ts))
    ranked = hits.select(*s.keys, s.ts, F.col("_delta").alias("delta")).withColumn("recency", F.row_number().over(newest))
    return ranked.filter(F.col("recency") <= n)


def window_instability(df: DataFrame, s: Series, bucket: str = "10 minutes", jump: float = 200.0) -> DataFrame:
    """One 0-1 score per series and bucket from relative spread, steps and swing."""
    b = replace(s, keys=(*s.keys, "bucket"))
    at = df.withColumn("bucket", F.window(s.ts, bucket).start)
    near = with_neighbours(at, b, back=9).withColumns(
        {
            "_std": F.stddev_samp(s.value).over(b.window.rowsBetween(-9, 0)),
            "_jump": F.abs(F.col(s.value) - F.lag(s.value).over(b.window)) > jump,
        }
    )
    stats = home(near).groupBy(*b.keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(s.value).alias("_mean"),
        F.avg("_std").alias("_avg_std"),
        F.count_if("_jump").alias("jumps"),
        (F.max(s.value) - F.min(s.value)).alias("_swing"),
    )

    def capped(x: Column) -> Column:
        return F.least(F.lit(1.0), x)

    ratio = capped(F.try_divide("_avg_std", "_mean"))
    score = 0.4 * ratio + 0.35 * capped(F.col("jumps") / 6.0) + 0.25 * capped(F.try_divide("_swing", "_mean"))
    quiet = (F.col("rows") < 3) | (F.col("_mean") < 1.0)
    return stats.select(*b.keys, "rows", "jumps", F.when(quiet, 0.0).otherwise(clip(score, 0, 1)).alias("score"))


def status_summary(observed: DataFrame, jumps: DataFrame, units: DataFrame, s: Series) -> DataFrame:
    """Latest power and risk, number of recent jumps and of running units per series.

    ``units`` has the keys and ``is_on``.
    """
    last = F.max_by(F.struct(s.ts, F.col(s.value).alias("power"), "cycling_risk", "instability_score", "is_cycling"), s.ts)
    newest = observed.groupBy(*s.keys).agg(last.alias("_x")).select(*s.keys, "_x.*")
    steps = jumps.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("recent_jumps"))
    active = units.groupBy(*s.keys).agg(F.count_if("is_on").alias("active_units"))
    out = newest.join(steps, list(s.keys), "left").join(active, list(s.keys), "left")
    return out.withColumns(
        {
            "instability_score": dashboard_round("instability_score", 3),
            **{c: F.coalesce(c, F.lit(0)) for c in ("recent_jumps", "active_units")},
        }
    )


def risk_bands(observed: DataFrame, keys: Sequence[str] = (), risk: str = "cycling_risk") -> DataFrame:
    """Percent of readings at high, medium and low risk, with mean and maximum."""
    r = F.col(risk)

    def pct(cond: Column) -> Column:
        return F.avg(cond.cast("int")) * 100

    return observed.groupBy(*keys).agg(
        pct(r > 0.7).alias("high_pct"),
        pct((r > 0.5) & (r <= 0.7)).alias("medium_pct"),
        pct(r <= 0.5).alias("low_pct"),
        F.avg(r).alias("mean_risk"),
        F.max(r).alias("max_risk"),
    )


def validation_report(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Named checks, one row each, with the number of passed checks of the key.

    ``metrics`` has one row per key: min_stable_power, high_risk_pct, actions, stable_pct
    and low_power_stable_pct.
    """
    # fixed values: the checks and their limits
    checks = (
        ("Analyzer identifies low-power zones (<700W)", "min_stable_power", lambda x: x < 700),
        ("Observer detects cycling events", "high_risk_pct", lambda x: x > 0),
        ("Controller makes decisions", "actions", lambda x: x > 0),
        ("Stable time >= 40%", "stable_pct", lambda x: x >= 40),
        ("Low-power stable >= 20%", "low_power_stable_pct", lambda x: x >= 20),
    )
    rows = [
        F.struct(
            F.lit(name).alias("check"),
            F.col(c).cast("double").alias("value"),
            F.coalesce(test(F.col(c)), F.lit(False)).alias("passed"),
        )
        for name, c, test in checks
    ]
    passed = sum((r.getField("passed").cast("int") for r in rows), F.lit(0))
    return metrics.select(*keys, passed.alias("passed_count"), F.inline(F.array(*rows)))
