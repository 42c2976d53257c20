"""Sources, sinks and scans."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from catalog.registry import LONG, READINGS, TELEMETRY, long, query, readings, rounded
from wattloom.operators import scan as ops
from wattloom.session import checkpoint_dir
from wattloom.sources import readers, sinks

UTC = dt.timezone.utc


def scratch(t, name):
    """A new shared folder for written data."""
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def stamp():
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


@query("read_telemetry_csv", "SELECT ts, value FROM events")
def _(t):
    path = scratch(t, "csv")
    t.events.select(stamp().alias("ts"), "value").write.option("header", True).csv(path)
    return readers.read_telemetry_csv(t.spark, path)



@query("read_query_response", "SELECT event_type AS entity, ts, value FROM events")
def _(t):
    path = scratch(t, "responses")
    df = t.events.withColumn("entity_id", F.col("event_type"))
    sinks.write_responses(df, t.S, path, {"time": stamp(), "value": F.col("value").cast("string")}, F.col("entity_id").alias("entity"), rows=100)
    return readers.read_query_response(t.spark, path, lines=True).drop("source")


@query(
    "read_state_records",
    f"""WITH {READINGS} SELECT event_type AS room, ts, value AS current_temp, CASE WHEN k < 90 THEN k / 4.0::DOUBLE END AS target_temp,
      CASE WHEN k < 50 THEN 'auto' ELSE 'low' END AS fan_mode, CASE WHEN k < 30 THEN 'off' ELSE 'heat' END AS hvac_state,
      CASE WHEN k < 30 THEN 'idle' ELSE 'heating' END AS hvac_action FROM readings""",
)
def _(t):
    path = scratch(t, "states")
    k = F.col("k")
    columns = {
        "time": stamp(),
        "current_temperature": F.col("value").cast("string"),
        "temperature": F.when(k < 90, (k / 4.0).cast("string")).otherwise("unavailable"),
        "fan_mode": F.when(k < 50, "auto").otherwise("low"),
        "state": F.when(k < 30, "off").otherwise("heat"),
        "hvac_action_str": F.when(k < 30, "idle").otherwise("heating"),
    }
    df = readings(t).withColumn("entity_id", F.col("event_type"))
    sinks.write_responses(df, t.S, path, columns, F.concat(F.lit("ac_"), "entity_id").alias("room"), rows=100)
    return readers.read_state_records(t.spark, path, lines=True)


@query(
    "scan_entity_range",
    f"""WITH {TELEMETRY} SELECT entity_id, ts, value FROM telemetry
      WHERE entity_id = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'""",
)
def _(t):
    return ops.scan_entity_range(t.telemetry, "click", dt.datetime(2024, 1, 5, tzinfo=UTC), dt.datetime(2024, 1, 20, tzinfo=UTC))


_HOURLY = "hourly AS (SELECT entity_id, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS bucket, avg(value) AS value FROM telemetry GROUP BY ALL)"


@query("resample_mean", f"WITH {TELEMETRY}, {_HOURLY} SELECT * FROM hourly")
def _(t):
    return ops.resample_mean(t.telemetry, t.S, "1 hour")


@query(
    "resample_mean_nullfill",
    f"""WITH {TELEMETRY}, {_HOURLY}, grid AS (
      SELECT entity_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL '1 hour')) AS bucket FROM hourly GROUP BY 1)
    SELECT entity_id, bucket, value FROM grid LEFT JOIN hourly USING (entity_id, bucket)""",
)
def _(t):
    return ops.resample_mean_nullfill(t.telemetry, t.S, "1 hour")


@query(
    "measurement_autodetect",
    f"""WITH {LONG}, o AS (SELECT *, list_position(['W', '°C', 'kW', 'kWh', '%', 'state', ' '], measurement) AS p FROM long)
    SELECT entity_id, measurement, ts, value FROM o QUALIFY p = min(p) OVER (PARTITION BY entity_id)""",
)
def _(t):
    return ops.measurement_autodetect(long(t)).select("entity_id", "measurement", "ts", "value")


@query("list_entities", f"WITH {LONG} SELECT DISTINCT entity_id FROM long WHERE contains(lower(entity_id), 'y_1')")
def _(t):
    return ops.list_entities(long(t), "Y_1")


@query("list_measurements", f"WITH {LONG} SELECT DISTINCT measurement FROM long WHERE regexp_matches(lower(measurement), 'kw|state')")
def _(t):
    return ops.list_measurements(long(t), ("kw", "state"))


@query("list_fields", f"WITH {LONG} SELECT DISTINCT field FROM long WHERE measurement = 'W'")
def _(t):
    return ops.list_fields(long(t), "W")


@query(
    "query_range_pivot",
    f"""WITH {LONG} SELECT entity_id, ts, any_value(value) FILTER (field = 'f1') AS f1, any_value(value) FILTER (field = 'f2') AS f2
    FROM long WHERE measurement = 'W' AND field IN ('f1', 'f2') AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-28' GROUP BY 1, 2""",
)
def _(t):
    start, stop = dt.datetime(2024, 1, 2, tzinfo=UTC), dt.datetime(2024, 1, 28, tzinfo=UTC)
    return ops.query_range_pivot(long(t), "W", ["f1", "f2"], start, stop, t.S)


@query(
    "align_entities",
    f"""WITH {TELEMETRY} SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS bucket,
      avg(value) FILTER (entity_id = 'click') AS click, avg(value) FILTER (entity_id = 'view') AS "view",
      avg(value) FILTER (entity_id = 'error') AS error
    FROM telemetry WHERE entity_id IN ('click', 'view', 'error') GROUP BY 1""",
)
def _(t):
    return ops.align_entities(t.telemetry, ["click", "view", "error"], t.S, "1 hour")


_STATES = f"""{READINGS}, states AS (SELECT entity_id, ts, us,
    CASE WHEN k < 10 THEN 'unavailable' WHEN k < 20 THEN 'unknown' WHEN k < 25 THEN 'on' ELSE CAST(value AS VARCHAR) END AS state FROM readings)"""


def states(t):
    k = F.col("k")
    text = F.when(k < 10, "unavailable").when(k < 20, "unknown").when(k < 25, "on").otherwise(F.col("value").cast("string"))
    return readings(t).select("entity_id", "ts", text.alias("state"))


@query("coerce_numeric", f"WITH {_STATES} SELECT entity_id, ts, TRY_CAST(state AS DOUBLE) AS state FROM states")
def _(t):
    return ops.numeric_readings(states(t), "state")


@query(
    "read_state_history",
    f"""WITH {_STATES} SELECT entity_id, ts, value FROM (
      SELECT entity_id, ts, TRY_CAST(state AS DOUBLE) AS value, max(ts) OVER (PARTITION BY entity_id) - INTERVAL 7 DAY AS since FROM states)
    WHERE ts >= since AND value IS NOT NULL""",
)
def _(t):
    return ops.read_state_history(states(t), t.S)


@query(
    "tail_period",
    f"""WITH {TELEMETRY} SELECT entity_id, ts, value FROM telemetry
    QUALIFY ts > max(ts) OVER (PARTITION BY entity_id) - INTERVAL 24 HOUR""",
)
def _(t):
    return ops.tail_period(t.telemetry, t.S)


@query("distinct_union", "SELECT DISTINCT id FROM (SELECT user_id AS id FROM events UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier)")
def _(t):
    return ops.distinct_union(
        t.events.select(F.col("user_id").alias("id")),
        t.table("customer").select(F.col("c_custkey").alias("id")),
        t.table("supplier").select(F.col("s_suppkey").alias("id")),
    )


def zone_rows(t):
    """Clusters of readings as zones: one per event type."""
    return t.telemetry.groupBy("entity_id").agg(
        F.avg("value").alias("power_mean"),
        F.stddev_pop("value").alias("power_std"),
        F.min("value").alias("power_min"),
        F.max("value").alias("power_max"),
        F.count(F.lit(1)).alias("samples"),
    ).select(F.when(F.col("power_max") > 3500, "unstable").otherwise("stable").alias("kind"), F.length("entity_id").cast("long").alias("cluster_id"), "power_mean", "power_std", "power_min", "power_max", "samples")


@query(
    "write_zones",
    f"""WITH {TELEMETRY} SELECT CASE WHEN max(value) > 3500 THEN 'unstable' ELSE 'stable' END AS kind, CAST(length(entity_id) AS BIGINT) AS cluster_id,
      round(avg(value), 6) AS power_mean, round(stddev_pop(value), 6) AS power_std, min(value) AS power_min, max(value) AS power_max,
      count(*) AS samples, '2024-02-01' AS version FROM telemetry GROUP BY entity_id""",
)
def _(t):
    path = scratch(t, "zones")
    zones = zone_rows(t)
    sinks.write_zones(zones.filter("kind = 'stable'"), path, "2024-01-01")
    sinks.write_zones(zones, path, "2024-02-01")
    return rounded(readers.read_zones(t.spark, path), "power_mean", "power_std").withColumn("version", F.col("version").cast("string"))


@query(
    "read_zones",
    f"""WITH {TELEMETRY} SELECT 'stable' AS kind, CAST(length(entity_id) AS BIGINT) AS cluster_id, round(avg(value), 6) AS power_mean, round(stddev_pop(value), 6) AS power_std,
      min(value) AS power_min, max(value) AS power_max, count(*) AS samples, '2024-01-01' AS version FROM telemetry GROUP BY entity_id HAVING max(value) <= 3500""",
)
def _(t):
    # an earlier version stays readable after a later one
    path = scratch(t, "zones")
    zones = zone_rows(t)
    sinks.write_zones(zones.filter("kind = 'stable'"), path, "2024-01-01")
    sinks.write_zones(zones, path, "2024-02-01")
    return rounded(readers.read_zones(t.spark, path, "2024-01-01"), "power_mean", "power_std")
