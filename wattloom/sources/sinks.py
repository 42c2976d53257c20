"""Writers for learned zones, episodes and rankings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.operators.windows import row_index
from wattloom.series import Series


# JSON keeps microseconds only when told to
JSON_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_telemetry(df: DataFrame, path: str) -> None:
    """Parquet laid out by measurement and day, so entity and time filters skip files."""
    day = F.to_date("ts").alias("day")
    (
        df.select("*", day)
        .repartitionByRange("measurement", "day", "entity_id", "ts")
        .sortWithinPartitions("measurement", "day", "entity_id", "ts")
        .write.mode("append")
        .partitionBy("measurement", "day")
        .parquet(path)
    )


def write_responses(df: DataFrame, s: Series, path: str, columns: Mapping[str, Column], folder: Column, rows: int = 1000, name: str = "state") -> None:
    """Saved query responses of at most ``rows`` rows each, one JSON line a response, in folders by ``folder``.

    Rows of a series are numbered in time order first, so a response is bounded however many rows a series has.
    ``columns`` are text columns, the first one the time. The readers split responses into rows again.
    """
    numbered = row_index(df, s, "_no").withColumn("_part", F.floor((F.col("_no") - 1) / rows))
    row = F.struct(F.col("_no"), F.array(*columns.values()).alias("row"))
    parts = numbered.groupBy(*s.keys, "_part", folder).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    series = F.struct(
        F.lit(name).alias("name"), F.array(*[F.lit(c) for c in columns]).alias("columns"), F.transform("_rows", lambda r: r["row"]).alias("values")
    )
    response = F.to_json(F.struct(F.array(F.struct(F.array(series).alias("series"))).alias("results")))
    parts.select(folder, response.alias("value")).write.mode("append").partitionBy(parts.select(folder).columns[0]).text(path)


def write_zones(zones: DataFrame, path: str, version: str) -> None:
    """One folder per version, so earlier zones stay readable."""
    zones.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").json(path)


def zone_config(clusters: DataFrame, quantile_threshold: Column, method: str = "gmm", stable_below: float = 50.0) -> DataFrame:
    """One row: method, all clusters by rising median std, the threshold and the stable clusters.

    Clusters are a handful of rows by construction (the number of mixture components).
    """
    ranked = F.sort_array(F.collect_list(F.struct("power_std_median", "cluster", "size", "power_mean", "power_median", "power_std_mean")))
    stable = F.sort_array(F.collect_list(F.when(F.col("power_std_median") < stable_below, F.col("cluster"))))
    return clusters.agg(ranked.alias("clusters"), stable.alias("stable_clusters")).select(
        F.lit(method).alias("method"), "clusters", quantile_threshold.alias("quantile_threshold"), "stable_clusters"
    )


def write_zone_config(config: DataFrame, path: str) -> None:
    config.write.mode("overwrite").json(path)


def append_episodes(episodes: DataFrame, path: str) -> None:
    """One JSON line per episode; earlier lines stay."""
    episodes.write.mode("append").option("timestampFormat", JSON_STAMP).json(path)


def write_feature_importance(ranking: DataFrame, path: str) -> None:
    """Ranked (feature, importance) rows - as many as the model has features - in one CSV."""
    ranking.orderBy(F.desc("importance"), "feature").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
