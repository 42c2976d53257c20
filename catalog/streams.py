"""Streaming counterparts, fed from the table's own files."""

import datetime as dt

from pyspark.sql import functions as F

from catalog.aggregates import EMERGENCY_ROWS, EMERGENCY_WINDOWS
from catalog.cycling import CYCLES
from catalog.joins import ZONES, zones
from catalog.observing import OBS
from catalog.registry import READINGS, TELEMETRY, S, Tables, query, rounded
from catalog.scans import scratch
from wattloom.sources import readers
from wattloom.streaming import live


def stream(t: Tables):
    """The events table as a stream of telemetry."""
    events = t.spark.readStream.schema(t.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    ts = F.col("ts").cast("timestamp").alias("ts")
    value = F.floor(F.col("value") * 10).cast("double").alias("value")
    return events.select(F.col("event_type").alias("entity_id"), ts, value, (F.col("user_id") % 10).alias("site_id"))


def drain(t, df, name, mode="append"):
    """Run the stream to its end and read back what it wrote."""
    path = scratch(t, name)
    live.append_stream(df, f"{path}/out", f"{path}/checkpoint", mode).awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{path}/out")


def drain_held(t, name, build):
    """Run the held stream that ``build`` makes of the readings to the end of the table, and read back what it wrote.

    Once the table has been read, a closing reading far ahead of all moves the watermark past them and so releases
    what is held. It comes from a folder of its own, stays above the watermark and never comes out itself.
    """
    path = scratch(t, name)
    readings = stream(t)
    closing = t.spark.createDataFrame([("", dt.datetime(2200, 1, 1, tzinfo=dt.timezone.utc), 1e9, 0)], readings.schema)
    closing.limit(0).write.parquet(f"{path}/closing")
    df = build(readings.unionByName(t.spark.readStream.schema(readings.schema).parquet(f"{path}/closing")))
    live.append_stream(df, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    closing.write.mode("append").parquet(f"{path}/closing")
    live.append_stream(df, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{path}/out")


@query(
    "stream_resample",
    f"""WITH {TELEMETRY}, b AS (SELECT entity_id, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS bucket, avg(value) AS value FROM telemetry GROUP BY 1, 2)
    SELECT * FROM b WHERE epoch_us(bucket) + 3600000000 <= ((SELECT max(us) FROM telemetry) - 7200000000) // 1000 * 1000""",
)
def _(t):
    df = live.stream_resample(stream(t).drop("site_id"), S, "1 hour", "2 hours")
    return drain(t, df, "resample")


@query("stream_observer", f"WITH {TELEMETRY}, {OBS} SELECT entity_id, ts, value, round(score, 6) AS instability_score, score > 0.6 AS is_cycling FROM obs")
def _(t):
    df = drain_held(t, "observer", lambda readings: live.stream_observer(readings, S, "2 hours"))
    return rounded(df.drop("cycling_risk"), "instability_score")


@query("stream_cycles", f"WITH {TELEMETRY}, {CYCLES} SELECT * FROM cycles")
def _(t):
    df = drain_held(t, "cycles", lambda readings: live.stream_cycles(readings, S, on=300, off=150, delay="2 hours"))
    return rounded(df, "avg_power")


@query(
    "stream_stability_emergency",
    f"""WITH {TELEMETRY}, {EMERGENCY_WINDOWS} {EMERGENCY_ROWS} WHERE epoch_us(bucket) + 600000000 <= ((SELECT max(us) FROM telemetry) - 7200000000) // 1000 * 1000""",
)
def _(t):
    df = live.stream_stability_emergency(stream(t), S, "10 minutes", "3 hours", "2 hours")
    return rounded(drain(t, df, "emergency"), "power_std")


@query(
    "stream_zone_flag",
    f"""WITH {TELEMETRY}, {ZONES} SELECT entity_id, ts, value, EXISTS (SELECT 1 FROM zones z WHERE z.entity_id = t.entity_id AND t.value BETWEEN z.lo AND z.hi) AS in_unstable FROM telemetry t""",
)
def _(t):
    df = live.stream_zone_flag(stream(t).drop("site_id"), zones(t), ("entity_id",))
    return drain(t, df, "zones")


@query(
    "stream_episode_sink",
    f"""WITH {READINGS} SELECT site_id, ts, floor(value * 10) AS power, -(floor(value * 10) / 500) AS energy FROM readings""",
)
def _(t):
    power = F.col("value")
    none = F.lit(None)
    df = stream(t).select(
        F.col("site_id").cast("long").alias("site_id"),
        "ts",
        F.struct(power.alias("power"), none.cast("double").alias("outdoor_temp"), F.lit(0.0).alias("total_delta_abs"), none.cast("map<string,double>").alias("rooms")).alias("state"),
        F.struct((-(power / 500)).alias("total"), F.lit(0.0).alias("comfort"), F.lit(0.0).alias("stability"), (-(power / 500)).alias("energy")).alias("reward"),
    )
    path = scratch(t, "episodes")
    live.stream_episode_sink(df, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    back = readers.read_episodes(t.spark, f"{path}/out")
    return back.select("site_id", "ts", "state.power", "reward.energy")


@query(
    "stream_cooldown",
    f"""WITH RECURSIVE {READINGS}, w AS (SELECT event_type AS entity_id, site_id, ts, us, floor(value * 10) > 1000 AS urgent FROM readings),
      act AS (SELECT entity_id, site_id, min(us) AS us FROM w GROUP BY ALL
        UNION ALL SELECT a.entity_id, a.site_id, min(w.us) AS us FROM act a JOIN w ON w.entity_id = a.entity_id AND w.site_id = a.site_id
          AND w.us - a.us >= CASE WHEN urgent THEN 18000000000 ELSE 43200000000 END GROUP BY a.entity_id, a.site_id)
    SELECT entity_id, site_id, ts, urgent AS is_emergency FROM act JOIN w USING (entity_id, site_id, us)""",
)
def _(t):
    from wattloom.series import Series

    def build(readings):
        # every reading wants an action
        wanted = readings.select("entity_id", "site_id", "ts", (F.col("value") > 1000).alias("is_emergency"))
        return live.stream_cooldown(wanted, Series(keys=("entity_id", "site_id")), minutes=720, emergency_minutes=300, delay="2 hours")

    return drain_held(t, "cooldown", build)
