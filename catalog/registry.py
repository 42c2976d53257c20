"""Registration of queries and the adapters from the given tables to telemetry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom import series
from wattloom.series import Series


@dataclass(frozen=True)
class Query:
    run: Callable
    sql: str | None


REGISTRY: dict[str, Query] = {}
_FITTED: dict[tuple, Series] = {}


class Tables:
    """The given tables, seen as telemetry."""

    def __init__(self, spark: SparkSession, folder: str):
        # instants are printed and compared as UTC wall-clock time
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def _fitted(self, name: str, df: DataFrame, s: Series) -> Series:
        """Slices cut once for a folder and session."""
        at = (self.spark.sparkContext.applicationId, self.folder, name, series.TARGET_ROWS)
        if at not in _FITTED:
            _FITTED[at] = series.fitted(df, s)
        return _FITTED[at]

    @property
    def S(self) -> Series:
        """Series by entity: of the long series and of the users'."""
        names = F.explode(F.array("event_type", F.col("user_id").cast("string")))
        return self._fitted("entity", self.events.select(names.alias("entity_id"), "ts"), Series())

    @property
    def SITE(self) -> Series:
        stamps = self.events.select((F.col("user_id") % 10).alias("site_id"), "ts")
        return replace(self._fitted("site", stamps, Series(keys=("site_id",))), value="power")

    @property
    def SITE_CYCLE(self) -> Series:
        return replace(self.SITE, ts="cycle", value="value")

    @property
    def AT_ROOM(self) -> Series:
        return replace(self.SITE_CYCLE, keys=("site_id", "room"))

    @property
    def telemetry(self) -> DataFrame:
        """Five long series: one per event type; readings are whole watts."""
        return self.events.select(
            F.col("event_type").alias("entity_id"), "ts", F.floor(F.col("value") * 10).cast("double").alias("value")
        )

    @property
    def by_user(self) -> DataFrame:
        """Many short series: one per user."""
        return self.events.select(
            F.col("user_id").alias("entity_id"), "ts", F.floor(F.col("value") * 10).cast("double").alias("value")
        )


# the same adapter in SQL
TELEMETRY = """telemetry AS (
  SELECT event_type AS entity_id, ts, epoch_us(ts) AS us, floor(value * 10) AS value FROM events)"""
BY_USER = """telemetry AS (
  SELECT user_id AS entity_id, ts, epoch_us(ts) AS us, floor(value * 10) AS value FROM events)"""

# streams take the description of a series only; slices are of batch queries
S = Series()
W = "PARTITION BY entity_id ORDER BY us"


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return add


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def wall_clock(df: DataFrame) -> DataFrame:
    """Timestamps as plain UTC wall-clock time, the form the tables have."""
    stamps = {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"}
    return df.withColumns(stamps) if stamps else df


# -- further adapters ---------------------------------------------------------------
# Readings are multiples of 1/16, so sums and means are the same in any order.

READINGS = """readings AS (
  SELECT event_id, ts, epoch_us(ts) AS us, user_id, user_id % 10 AS site_id, event_type, value,
    CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k,
    'entity_' || user_id AS entity_id,
    CASE event_type WHEN 'click' THEN 'kWh' WHEN 'view' THEN '°C' WHEN 'error' THEN 'W' WHEN 'purchase' THEN '%' ELSE 'state' END AS measurement
  FROM events)"""

LONG = f"""{READINGS}, long AS (
  SELECT site_id, entity_id, measurement, 'f' || (event_id % 4) AS field, ts, us, floor(value * 10) AS value FROM readings)"""

CHANNELS = f"""{READINGS}, chan AS (SELECT site_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS ts,
    avg(CASE WHEN event_type = 'click' THEN floor(value * 10) END) AS power,
    avg(CASE WHEN event_type = 'view' THEN floor(value) / 8.0::DOUBLE - 5 END) AS outdoor_temp,
    avg(CASE WHEN event_type = 'error' THEN 18 + floor(value) / 16.0::DOUBLE END) AS temp_eg,
    avg(CASE WHEN event_type = 'purchase' THEN 20 + floor(k / 25.0) * 0.5::DOUBLE END) AS target_eg,
    avg(CASE WHEN event_type = 'signup' THEN CASE WHEN value > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS unit_eg
  FROM readings GROUP BY ALL), channels AS (SELECT *, epoch_us(ts) AS us FROM chan)"""

ROOM_STATE = f"""{READINGS}, room_state AS (
  SELECT site_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS cycle, event_type AS room,
    18 + floor(arg_max(value, us)) / 16.0::DOUBLE AS current_temp,
    20 + floor(arg_max(k, us) / 25.0) * 0.5::DOUBLE AS target_temp,
    CASE WHEN arg_max(k, us) % 50 < 15 THEN 'off' WHEN arg_max(k, us) % 50 < 18 THEN 'unavailable' ELSE 'heat' END AS hvac_mode
  FROM readings GROUP BY ALL),
  rooms_on AS (SELECT *, current_temp - target_temp AS delta, hvac_mode NOT IN ('off', 'unknown', 'unavailable') AS is_on FROM room_state)"""

# customers are rooms, suppliers outdoor units, nations sites
ROOMS = """rooms AS (SELECT c_nationkey AS site_id, c_custkey AS room,
    CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unit_' || (c_custkey % 97) ELSE (
      'unit_' || (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey)) END AS outdoor_unit FROM customer)"""
UNITS = """units0 AS (SELECT s_nationkey AS site_id, CASE WHEN s_suppkey % 9 = 0 THEN 'default' ELSE 'unit_' || s_suppkey END AS unit_id,
    s_suppkey AS position, CASE WHEN s_acctbal < 1000 THEN NULL WHEN s_acctbal < 5000 THEN 'cool' ELSE 'heat' END AS operating_mode,
    'sensor.p_' || s_suppkey AS power_sensor FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey,
      CASE WHEN s_suppkey % 9 = 0 THEN 'default' ELSE 'unit_' || s_suppkey END ORDER BY s_suppkey) = 1),
  units AS (SELECT site_id, unit_id, position, coalesce(operating_mode, 'heat') AS operating_mode, power_sensor FROM units0
    UNION ALL SELECT n_nationkey, 'default', 0, 'heat', 'sensor.n_' || n_nationkey FROM nation
    WHERE n_nationkey NOT IN (SELECT site_id FROM units0))"""


def readings(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("click", "kWh", "view", "°C", "error", "W", "purchase", "%", "signup", "state")])
    return t.events.select(
        "event_id",
        "ts",
        "user_id",
        (F.col("user_id") % 10).alias("site_id"),
        "event_type",
        "value",
        F.regexp_extract("props", r'"k": ([0-9]+)', 1).cast("int").alias("k"),
        F.concat(F.lit("entity_"), "user_id").alias("entity_id"),
        names[F.col("event_type")].alias("measurement"),
    )


def long(t: Tables) -> DataFrame:
    return readings(t).select(
        "site_id",
        "entity_id",
        "measurement",
        F.concat(F.lit("f"), F.col("event_id") % 4).alias("field"),
        "ts",
        F.floor(F.col("value") * 10).cast("double").alias("value"),
    )


CHANNEL_COLS = ("power", "outdoor_temp", "temp_eg", "target_eg", "unit_eg")


def channels(t: Tables) -> DataFrame:
    """One row per site and six hours, one column per channel."""
    return readings(t).groupBy("site_id", F.window("ts", "6 hours").start.alias("ts")).agg(
        F.avg(F.when(F.col("event_type") == "click", F.floor(F.col("value") * 10).cast("double"))).alias("power"),
        F.avg(F.when(F.col("event_type") == "view", F.floor("value") / 8.0 - 5)).alias("outdoor_temp"),
        F.avg(F.when(F.col("event_type") == "error", 18 + F.floor("value") / 16.0)).alias("temp_eg"),
        F.avg(F.when(F.col("event_type") == "purchase", 20 + F.floor(F.col("k") / 25) * 0.5)).alias("target_eg"),
        F.avg(F.when(F.col("event_type") == "signup", F.when(F.col("value") > 30, 1.0).otherwise(0.0))).alias("unit_eg"),
    )


def room_state(t: Tables) -> DataFrame:
    """One row per site, six-hour control cycle and room, from the latest reading."""
    newest = F.max_by(F.struct("value", "k"), "ts").alias("x")
    df = readings(t).groupBy("site_id", F.window("ts", "6 hours").start.alias("cycle"), F.col("event_type").alias("room")).agg(newest)
    mode = F.when(F.col("x.k") % 50 < 15, "off").when(F.col("x.k") % 50 < 18, "unavailable").otherwise("heat")
    df = df.select(
        "site_id",
        "cycle",
        "room",
        (18 + F.floor("x.value") / 16.0).alias("current_temp"),
        (20 + F.floor(F.col("x.k") / 25) * 0.5).alias("target_temp"),
        mode.alias("hvac_mode"),
    )
    from wattloom.functions.scalar import is_on

    return df.withColumns({"delta": F.col("current_temp") - F.col("target_temp"), "is_on": is_on("hvac_mode")})


def rooms(t: Tables) -> DataFrame:
    first = t.table("supplier").groupBy(F.col("s_nationkey").alias("site_id")).agg(F.min("s_suppkey").alias("_first"))
    c = t.table("customer").select(F.col("c_nationkey").alias("site_id"), F.col("c_custkey").alias("room")).join(first, "site_id", "left")
    kind = F.col("room") % 4
    unit = F.when(kind == 1, F.concat(F.lit("unit_"), F.col("room") % 97)).when(kind > 1, F.concat(F.lit("unit_"), "_first"))
    return c.withColumn("outdoor_unit", unit).drop("_first")


def units(t: Tables) -> DataFrame:
    from wattloom.operators.joins import unit_defaults

    key = F.col("s_suppkey")
    mode = F.when(F.col("s_acctbal") < 1000, None).when(F.col("s_acctbal") < 5000, "cool").otherwise("heat")
    listed = t.table("supplier").select(
        F.col("s_nationkey").alias("site_id"),
        F.when(key % 9 == 0, "default").otherwise(F.concat(F.lit("unit_"), key)).alias("unit_id"),
        key.alias("position"),
        mode.alias("operating_mode"),
        F.concat(F.lit("sensor.p_"), key).alias("power_sensor"),
    )
    first = F.min_by(F.struct("operating_mode", "power_sensor"), "position").alias("x")
    listed = listed.groupBy("site_id", "unit_id").agg(F.min("position").alias("position"), first).select(
        "site_id", "unit_id", "position", "x.*"
    )
    sites = t.table("nation").select(
        F.col("n_nationkey").alias("site_id"),
        F.lit("heat").alias("operating_mode"),
        F.concat(F.lit("sensor.n_"), "n_nationkey").alias("power_sensor"),
    )
    return unit_defaults(listed, sites)
