"""Changes between stable and unstable phases and what goes with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.scalar import phase
from wattloom.operators.cycling import runs_where
from wattloom.operators.joins import event_window
from wattloom.operators.stats import corr_with_target
from wattloom.series import ORD, Series, home, plain, with_neighbours


def with_phases(df: DataFrame, s: Series, n: int = 6, stable: float = 50.0, unstable: float = 120.0) -> DataFrame:
    """power_std over n rows, phase, prev_phase and the transition, in one pass.

    n rows back are enough for the std of the previous row, too.
    """
    frame = s.window.rowsBetween(-(n - 1), 0)
    near = with_neighbours(df, s, back=n).withColumn("power_std", F.stddev_samp(s.value).over(frame))
    near = near.withColumn("phase", phase("power_std", stable, unstable))
    near = near.withColumn("prev_phase", F.lag("phase").over(s.window))
    was, is_ = F.col("prev_phase"), F.col("phase")
    change = F.when((was == "stable") & (is_ == "unstable"), "to_unstable").when(
        (was == "unstable") & (is_ == "stable"), "to_stable"
    )
    return home(near.withColumn("transition", change))


def phase_transitions(df: DataFrame, s: Series, n: int = 6, stable: float = 50.0, unstable: float = 120.0) -> DataFrame:
    """The rows at which a stable phase turns unstable or the other way round."""
    changed = plain(with_phases(df, s, n, stable, unstable)).filter("transition is not null")
    return changed.select(*s.keys, s.ts, s.value, "power_std", "transition")


def transition_impact(
    df: DataFrame,
    s: Series,
    channels: Sequence[str],
    width: str = "30 minutes",
    n: int = 6,
    stable: float = 50.0,
    unstable: float = 120.0,
    kind: str = "to_unstable",
) -> DataFrame:
    """Before, after and delta of every numeric channel around each transition."""
    phased = plain(with_phases(df, s, n, stable, unstable))
    return event_window(phased, s, F.col("transition") == kind, channels, width)


def impact_ranking(impact: DataFrame, channels: Sequence[str], power: str = "power", top: int = 15) -> DataFrame:
    """Which channel deltas go with the power delta."""
    others = [f"{c}_delta" for c in channels if c != power]
    return corr_with_target(impact, f"{power}_delta", others, top=top)


def long_stable_runs(
    df: DataFrame,
    s: Series,
    channels: Sequence[str] = (),
    min_rows: int = 6,
    minutes_per_row: int = 5,
    n: int = 6,
    stable: float = 50.0,
    unstable: float = 120.0,
) -> DataFrame:
    """Uninterrupted stable phases of at least ``min_rows`` rows."""
    phased = with_phases(df, s, n, stable, unstable)
    aggs = [
        F.timestamp_micros(F.min(ORD)).alias("start"),
        F.timestamp_micros(F.max(ORD)).alias("end"),
        F.count(F.lit(1)).alias("rows"),
        F.avg(s.value).alias("power_mean"),
        F.avg("power_std").alias("power_std"),
        *[F.avg(c).alias(c) for c in channels],
    ]
    runs = runs_where(phased, s, F.col("phase") == "stable", aggs).filter(F.col("rows") >= min_rows)
    return runs.withColumn("duration_minutes", F.col("rows") * minutes_per_row)


def stable_run_summary(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("power_mean").alias("avg_power"),
        F.avg("power_std").alias("avg_std"),
        F.avg("duration_minutes").alias("avg_minutes"),
        F.max("duration_minutes").alias("max_minutes"),
        F.min("duration_minutes").alias("min_minutes"),
    )
