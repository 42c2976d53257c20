"""Readers for telemetry files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.scalar import coerce_numeric

CSV_SCHEMA = "ts timestamp, value double"
RESPONSE_SCHEMA = (
    "results array<struct<series: array<struct<name: string, columns: array<string>, values: array<array<string>>>>>>"
)
ZONE_SCHEMA = (
    "kind string, cluster_id long, power_mean double, power_std double, power_min double, power_max double, samples long"
)
EPISODE_SCHEMA = """
  site_id long, ts timestamp,
  state struct<power: double, outdoor_temp: double, total_delta_abs: double, rooms: map<string, double>>,
  actions array<struct<room: string, action_type: string, old_target: double, new_target: double, reason: string, unit_id: string>>,
  reward struct<total: double, comfort: double, stability: double, energy: double>,
  unstable_zones array<struct<min: double, max: double>>,
  outdoor_units map<string, string>
"""


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, the timestamp first and then ``value``."""
    return spark.read.schema(CSV_SCHEMA).option("header", True).csv(path)


def _first_series(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Rows of the first series of the first result; folders like ``room=x`` become columns."""
    saved = spark.read.schema(RESPONSE_SCHEMA).option("multiLine", not lines).json(path)
    series = F.col("results").getItem(0).getField("series").getItem(0)
    folders = [c for c in saved.columns if c != "results"]
    saved = saved.select(*folders, F.col("_metadata.file_path").alias("source"), series.alias("s"))
    return saved.select(*folders, "source", "s.columns", F.explode("s.values").alias("row"))


def read_query_response(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved query responses: (ts, value) rows of the first series of the first result.

    One file is one response, or with ``lines`` one line is; files are read in parallel.
    """
    rows = _first_series(spark, path, lines)
    return rows.select(
        *rows.columns[:-2],
        F.col("row").getItem(0).cast("timestamp").alias("ts"),
        coerce_numeric(F.col("row").getItem(1)).alias("value"),
    )


def read_state_records(spark: SparkSession, path: str, lines: bool = False, room_prefix: str = "ac_") -> DataFrame:
    """Saved responses with named columns: one state record per row.

    The room is the ``room=`` folder, else the file name without ``room_prefix``.
    """
    rows = _first_series(spark, path, lines)
    named = rows.withColumn("m", F.map_from_arrays("columns", "row"))
    stem = F.regexp_extract("source", r"([^/]+?)(\.[^./]*)?$", 1)
    room = F.col("room") if "room" in rows.columns else stem
    return named.select(
        F.regexp_replace(room, f"^{room_prefix}", "").alias("room"),
        F.col("m")["time"].cast("timestamp").alias("ts"),
        coerce_numeric(F.col("m")["current_temperature"]).alias("current_temp"),
        coerce_numeric(F.col("m")["temperature"]).alias("target_temp"),
        F.col("m")["fan_mode"].alias("fan_mode"),
        F.col("m")["state"].alias("hvac_state"),
        F.col("m")["hvac_action_str"].alias("hvac_action"),
    )


def read_zones(spark: SparkSession, path: str, version: str | None = None, keys: str = "") -> DataFrame:
    """The newest version of the learned zones, or the named one; ``keys`` are the key columns as DDL."""
    schema = ", ".join(x for x in (keys, ZONE_SCHEMA, "status string" if keys else "", "version string") if x)
    zones = spark.read.schema(schema).json(path)
    if version is None:
        newest = zones.agg(F.max("version"))
        return zones.filter(F.col("version") == newest.scalar())
    return zones.filter(F.col("version") == version)


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EPISODE_SCHEMA).json(path)
