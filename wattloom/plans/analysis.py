"""Whole analyses of power series."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.operators import models
from wattloom.operators import zones as z
from wattloom.operators.clusters import gmm_bic_select
from wattloom.operators.scan import resample_mean
from wattloom.operators.stats import data_quality, data_sufficiency
from wattloom.operators.windows import trailing_exclusive
from wattloom.series import Series
from wattloom.session import saved


def regions_by_kmeans(metrics: DataFrame, keys: list[str], value: str = "value", seed: int = 42, restarts: int = 10, min_rows: int = 20, few: int = 100, **scoring) -> DataFrame:
    """Regions from each key's own clusters of (power, rolling std).

    A key with fewer than ``few`` complete rows has regions from power bins instead; ``method`` tells which.
    """
    cols = [value, "power_std"]
    # read by the fit, the labels and the bins
    metrics = saved(metrics.select(*keys, *[c for c in (*cols, "power_jump") if c in metrics.columns]), "metrics")
    fitted = models.k_means(metrics, keys, cols, lambda n: min(8, n // 150 + 3), restarts, seed=seed, min_rows=few)
    labelled = models.label(metrics, keys, cols, fitted, "region").filter("region IS NOT NULL")
    labelled = labelled.withColumn("region", F.col("region").cast("string"))
    regions = z.region_summary(labelled, [*keys, "region"], value, **scoring)
    regions = regions.filter(F.col("sample_count") >= min_rows).withColumn("method", F.lit("kmeans"))
    rest = metrics.join(fitted.filter("status = 'ok'").select(*keys).distinct(), keys, "left_anti")
    bins = z.regions_by_bins(rest, keys, value, **scoring).withColumn("method", F.lit("bins"))
    return regions.unionByName(bins).orderBy(*keys, "power_min")


def analyze_series(
    df: DataFrame,
    s: Series,
    method: str = "bins",
    min_rows: int = 1000,
    min_hours: int = 24,
    region_rows: int = 50,
    jump: float = 200.0,
    **scoring,
) -> DataFrame:
    """One row per series: sufficiency, quality, regions, minimum stable power and advice."""
    keys = list(s.keys)
    checked = data_sufficiency(df, s, min_rows, min_hours)
    enough = df.join(checked.filter("sufficient").select(*keys), keys, "left_semi")
    metrics = z.stability_metrics(enough, s, jump=jump)
    if method == "kmeans":
        regions = regions_by_kmeans(metrics, keys, s.value, **scoring)
    else:
        regions = z.regions_by_bins(metrics, keys, s.value, region_rows, **scoring)
    with_keys = checked.filter("sufficient").select(*keys)
    minimum = z.min_stable_power(regions, keys, with_keys)
    advice = z.recommendation(regions, minimum, keys)
    region = F.struct("power_min", "power_max", "name", "stability_score", F.col("avg_std").alias("fluctuation_rate"), "sample_count", F.struct(F.col("power_avg").alias("avg_power"), "avg_std").alias("conditions"))
    listed = regions.groupBy(*keys).agg(F.sort_array(F.collect_list(region)).alias("regions"))
    out = checked.join(data_quality(df, s), keys).join(advice, keys, "left").join(listed, keys, "left")
    return out.select(
        *keys,
        F.col("sufficient").alias("sufficient_data"),
        F.when(F.col("sufficient"), F.col("data_quality_score")).otherwise(0.0).alias("data_quality_score"),
        "min_stable_power",
        F.coalesce("recommendation", "message").alias("recommendation"),
        "regions",
    )


def learn_zones(
    df: DataFrame,
    s: Series,
    as_of=None,
    days: int = 30,
    bucket: str = "5 minutes",
    min_power: float = 50.0,
    n: int = 30,
    min_rows: int = 1000,
    min_windows: int = 100,
    ks=range(2, 6),
    seed: int = 42,
    restarts: int = 3,
    **labels,
) -> DataFrame:
    """Zones of each key from its last ``days`` before ``as_of`` (default: the key's newest reading).

    Bucket means of the running compressor, mean and population std of the n buckets before each, a Gaussian mixture
    of the key on both, then zones per cluster. ``status`` is ``ok``, or ``too_few_rows`` or ``too_few_windows`` for
    keys that get the fixed zones instead; so does, with ``no_zone``, a key none of whose clusters is large enough.
    """
    keys = list(s.keys)
    if as_of is None:
        newest = df.groupBy(*keys).agg(F.max(s.ts).alias("_until"))
        until, rows = F.col("_until"), df.join(newest, keys)
    else:
        until, rows = F.lit(as_of), df
    recent = rows.filter((F.col(s.ts) > until - F.expr(f"INTERVAL {days} DAYS")) & (F.col(s.ts) <= until))
    means = resample_mean(recent, s, bucket).filter(F.col(s.value) > min_power)
    b = replace(s, ts="bucket")
    # read by the fit and by the labels
    windows = saved(trailing_exclusive(means, b, n).select(*keys, "power_mean", "power_std"), "windows")
    # a row has its n rows before it unless it is one of the key's first n
    counts = means.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    state = F.when(F.col("_n") < min_rows, "too_few_rows").when(F.col("_n") - n < min_windows, "too_few_windows").otherwise("ok")
    status = df.select(*keys).distinct().join(counts, keys, "left").select(*keys, F.coalesce(state, F.lit("too_few_rows")).alias("status"))
    status = saved(status, "status")
    ready = windows.join(status.filter("status = 'ok'").select(*keys), keys, "left_semi")
    labelled, _ = gmm_bic_select(ready, ["power_mean", "power_std"], ks, keys, seed, restarts, scale=False)
    zones = saved(z.zones_from_labels(labelled, keys, **labels), "zones")
    zones = z.fallback_zones(zones, status, keys)
    fixed = F.col("cluster_id").isNull() & (F.col("status") == "ok")
    return zones.join(status, keys).withColumn("status", F.when(fixed, "no_zone").otherwise(F.col("status")))


def retrain_zones(df: DataFrame, s: Series, path: str, as_of, **options) -> DataFrame:
    """Learn the zones as of a moment and store them as a new version."""
    from wattloom.sources.readers import read_zones
    from wattloom.sources.sinks import write_zones

    version = as_of.strftime("%Y-%m-%dT%H%M%S")
    write_zones(learn_zones(df, s, as_of, **options), path, version)
    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in s.keys)
    return read_zones(df.sparkSession, path, version, keys)
