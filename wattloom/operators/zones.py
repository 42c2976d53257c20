"""Operating regions and stable / unstable power zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.scalar import clip, percent_int, power_bin_right, range_text, region_label, watts
from wattloom.operators.stats import quantiles
from wattloom.series import Series, plain, with_neighbours

# fixed values: zones used while there is not enough data (kind, power_mean, power_std, power_min, power_max)
FALLBACK = (
    ("unstable", None, None, 1000.0, 1500.0),
    ("stable", 500.0, 50.0, None, None),
    ("stable", 1800.0, 80.0, None, None),
)
ZONE_COLS = ("kind", "cluster_id", "power_mean", "power_std", "power_min", "power_max", "samples")
DEFAULT_MIN_STABLE = 450.0


def stability_metrics(df: DataFrame, s: Series, n: int = 10, full: float = 50.0, jump: float = 200.0) -> DataFrame:
    """Rolling std (0 if unknown) and mean (1 if unknown), instability and jump flag."""
    frame = s.window.rowsBetween(-(n - 1), 0)
    step = F.abs(F.col(s.value) - F.lag(s.value).over(s.window))
    near = with_neighbours(df, s, back=max(n - 1, 1)).withColumns(
        {
            "power_std": F.coalesce(F.stddev_samp(s.value).over(frame), F.lit(0.0)),
            "power_mean": F.coalesce(F.avg(s.value).over(frame), F.lit(1.0)),
            "power_jump": F.coalesce((step > jump).cast("int"), F.lit(0)),
        }
    )
    return plain(near.withColumn("instability", clip(F.col("power_std") / full, 0, 1)))


def region_summary(df: DataFrame, group: Sequence[str], value: str = "value", std: str = "power_std", jump: str = "power_jump", full_std: float = 100.0, full_rate: float = 12.0) -> DataFrame:
    """Power range, variation and 0-1 stability score per group."""
    avg_std = F.avg(std) if std in df.columns else F.lit(100.0)
    jump_rate = F.avg(jump) * 60 if jump in df.columns else F.lit(0.0)
    out = df.groupBy(*group).agg(
        F.min(value).alias("power_min"),
        F.max(value).alias("power_max"),
        F.avg(value).alias("power_avg"),
        avg_std.alias("avg_std"),
        jump_rate.alias("jump_rate"),
        F.count(F.lit(1)).alias("sample_count"),
    )
    zero = F.lit(0.0)
    score = 0.8 * F.greatest(zero, 1 - F.col("avg_std") / full_std) + 0.2 * F.greatest(
        zero, 1 - F.col("jump_rate") / full_rate
    )
    out = out.withColumn("stability_score", score)
    return out.withColumn("name", region_label("power_avg", "power_min", "power_max", "stability_score"))


def regions_by_bins(metrics: DataFrame, keys: Sequence[str], value: str = "value", min_rows: int = 50, **scoring) -> DataFrame:
    """Regions from fixed right-closed power bins with enough rows."""
    binned = metrics.withColumn("region", power_bin_right(value)).filter("region is not null")
    regions = region_summary(binned, [*keys, "region"], value, **scoring)
    return regions.filter(F.col("sample_count") >= min_rows).orderBy(*keys, "power_min")


def min_stable_power(regions: DataFrame, keys: Sequence[str], all_keys: DataFrame | None = None, floor: float = 300.0, good: float = 0.6) -> DataFrame:
    """Lowest power of the lowest stable region; see the fallbacks in the order of coalesce."""
    active = F.col("power_max") > floor
    stable = active & (F.col("stability_score") > good)
    middle = F.struct((F.col("power_min") + F.col("power_max")) / 2, F.col("power_min"))
    best = F.struct(F.col("stability_score"), -F.col("power_min"))
    lowest = F.min_by("power_min", F.when(stable, middle))
    steadiest = F.max_by("power_min", F.when(active, best))
    out = regions.groupBy(*keys).agg(
        F.coalesce(lowest, F.when(steadiest.isNotNull(), F.greatest(F.lit(400.0), steadiest)), F.lit(DEFAULT_MIN_STABLE)).alias("min_stable_power")
    )
    if all_keys is None:
        return out
    known = all_keys.join(out, list(keys), "left")
    return known.withColumn("min_stable_power", F.coalesce("min_stable_power", F.lit(DEFAULT_MIN_STABLE)))


# fixed values: texts of the recommendation
TXT_MIN = "Minimale stabile Last: "
TXT_RANGES = "Empfohlene Bereiche: "
TXT_NONE = "⚠ Kein stabiler Betriebsbereich gefunden."


def recommendation(regions: DataFrame, minimum: DataFrame, keys: Sequence[str], good: float = 0.6, decent: float = 0.4) -> DataFrame:
    """Text with the minimum load and the recommended ranges (a key has at most a dozen regions)."""
    score = F.col("stability_score")
    entry = F.struct(F.col("power_min"), F.col("power_max"))
    found = regions.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(score > good, entry))).alias("_good"),
        F.max_by(F.struct(entry.alias("r"), score.alias("s")), F.struct(score, -F.col("power_min"))).alias("_best"),
    )
    joined = minimum.join(found, list(keys), "left")
    decent_one = F.when(F.col("_best.s") > decent, F.array("_best.r"))
    ranges = F.when(F.size(F.coalesce("_good", F.array().cast("array<struct<power_min: double, power_max: double>>"))) > 0, F.col("_good")).otherwise(decent_one)
    texts = F.transform(ranges, lambda r: range_text(r["power_min"], r["power_max"]))
    ranges_text = F.coalesce(F.concat(F.lit(TXT_RANGES), F.array_join(texts, ", ")), F.lit(TXT_NONE))
    low = F.when(F.col("min_stable_power") != 0, F.concat(F.lit(TXT_MIN), watts("min_stable_power"), F.lit("W")))
    return joined.select(*keys, "min_stable_power", F.concat_ws(" | ", low, ranges_text).alias("recommendation"))


def region_dashboard(regions: DataFrame, keys: Sequence[str], stable: float = 0.7) -> DataFrame:
    """Range text, stability in percent and flag per region."""
    return regions.select(
        *keys,
        F.lit("ready").alias("status"),
        range_text("power_min", "power_max").alias("range"),
        percent_int("stability_score").alias("stability"),
        (F.col("stability_score") > stable).alias("is_stable"),
    )


def zones_from_labels(df: DataFrame, keys: Sequence[str] = (), cluster: str = "cluster", mean: str = "power_mean", std: str = "power_std", min_rows: int = 10, stable_below: float = 100.0) -> DataFrame:
    """Stable zones (mean, std) and unstable zones (10th to 90th percentile) from clusters."""
    group = [*keys, cluster]
    stats = df.groupBy(*group).agg(
        F.avg(mean).alias("_mean"), F.avg(std).alias("_std"), F.count(F.lit(1)).alias("samples")
    )
    stats = stats.filter(F.col("samples") >= min_rows)
    ends = quantiles(df, group, mean, {"_p10": 0.1, "_p90": 0.9})
    joined = stats.join(ends, group)
    stable = F.col("_std") < stable_below
    return joined.select(
        *keys,
        F.when(stable, "stable").otherwise("unstable").alias("kind"),
        F.col(cluster).cast("long").alias("cluster_id"),
        F.when(stable, F.col("_mean")).alias("power_mean"),
        F.col("_std").alias("power_std"),
        F.when(~stable, F.col("_p10")).alias("power_min"),
        F.when(~stable, F.col("_p90")).alias("power_max"),
        "samples",
    )


def _fallback_rows() -> Column:
    def number(x):
        return F.lit(x).cast("double")

    return F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(None).cast("long").alias("cluster_id"),
                number(mean).alias("power_mean"),
                number(std).alias("power_std"),
                number(lo).alias("power_min"),
                number(hi).alias("power_max"),
                F.lit(None).cast("long").alias("samples"),
            )
            for kind, mean, std, lo, hi in FALLBACK
        ]
    )


def fallback_zones(zones: DataFrame, all_keys: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The learned zones, and the fixed ones for keys that have none."""
    missing = all_keys.select(*keys).distinct().join(zones.select(*keys).distinct(), list(keys), "left_anti")
    fixed = missing.select(*keys, F.inline(_fallback_rows()))
    return zones.select(*keys, *ZONE_COLS).unionByName(fixed)
