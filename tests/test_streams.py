"""Streams run over several files give what the batch operators give."""

import random

import naive
import pytest
from conftest import rows
from pyspark.sql import functions as F

from wattloom.operators import cycling, observer, scan
from wattloom.series import Series, fitted
from wattloom.streaming import live

S = Series(slice="30 minutes")


@pytest.fixture(scope="module")
def readings(minutes):
    rng = random.Random(5)
    data = {k: [float(rng.choice([50, 120, 250, 400, 900])) for _ in range(150)] for k in ("a", "b")}
    return minutes(data).persist(), data


def feed(spark, df, folder, cuts=(0, 40, 41, 110, 150), late=None):
    """One file per batch, shuffled inside; ``late`` is a frame for the last file."""
    minute = F.floor(F.unix_timestamp("ts") / 60) - F.lit(1704067200 // 60)
    for lo, hi in zip(cuts, cuts[1:]):
        df.filter((minute >= lo) & (minute < hi)).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(folder)
    if late is not None:
        late.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, df, tmp_path):
    live.append_stream(df, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{tmp_path}/out")


def test_observer(spark, readings, tmp_path):
    df, data = readings
    got = drain(spark, live.stream_observer(feed(spark, df, f"{tmp_path}/in"), S, hold=False), tmp_path)
    want = observer.observer_risk(df, S)
    cols = ("entity_id", "ts", "value", "is_cycling", "instability_score")
    a, b = rows(got.select(*cols), "entity_id", "ts"), rows(want.select(*cols), "entity_id", "ts")
    assert [r[:4] for r in a] == [r[:4] for r in b]
    assert [r[4] for r in a] == pytest.approx([r[4] for r in b])
    assert [r[4] for r in a if r[0] == "a"] == pytest.approx(naive.risks(data["a"]))


def test_cycles(spark, readings, tmp_path):
    df, _ = readings
    got = drain(spark, live.stream_cycles(feed(spark, df, f"{tmp_path}/in"), S, 300, 150, hold=False), tmp_path)
    want = cycling.detect_cycles(df, S, 300, 150)
    assert rows(got, "entity_id", "start") == rows(want.select(*got.columns), "entity_id", "start")


def feed_unordered(spark, df, folder):
    """Six files, each with rows from all over half an hour, and from the half hours before and after."""
    minute = F.floor(F.unix_timestamp("ts") / 60) - F.lit(1704067200 // 60)
    spread = df.withColumn("_file", F.floor((minute + F.pmod(F.xxhash64("ts", "entity_id"), F.lit(45))) / 30))
    for k in sorted(r[0] for r in spread.select("_file").distinct().collect()):
        spread.filter(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_held_rows_come_in_time_order(spark, readings, tmp_path):
    df, _ = readings
    newest = df.agg(F.max("ts")).first()[0]
    # two hours of disorder are allowed, so a reading is out once the newest one is two hours ahead of it
    passed = F.col("ts") + F.expr("INTERVAL 2 HOURS") <= F.lit(newest)
    source = feed_unordered(spark, df, f"{tmp_path}/in")
    got = drain(spark, live.stream_observer(source, fitted(df, S), "2 hours"), tmp_path / "observer")
    cols = ("entity_id", "ts", "value", "is_cycling")
    assert rows(got.select(*cols), "entity_id", "ts") == rows(observer.observer_risk(df, S).filter(passed).select(*cols), "entity_id", "ts")
    assert got.count() > 20


def test_held_cycles(spark, readings, tmp_path):
    df, _ = readings
    newest = df.agg(F.max("ts")).first()[0]
    source = feed_unordered(spark, df, f"{tmp_path}/in")
    got = drain(spark, live.stream_cycles(source, fitted(df, S), 300, 150, "80 minutes"), tmp_path / "cycles")
    want = cycling.detect_cycles(df, S, 300, 150).filter(F.col("end") + F.expr("INTERVAL 80 MINUTES") <= F.lit(newest))
    assert got.count() > 3
    assert rows(got, "entity_id", "start") == rows(want.select(*got.columns), "entity_id", "start")


def test_held_cooldown(spark, readings, tmp_path):
    df, _ = readings
    df = df.withColumn("is_emergency", F.col("value") > 800)
    source = feed_unordered(spark, df, f"{tmp_path}/in")
    got = drain(spark, live.stream_cooldown(source, fitted(df, S), delay="80 minutes"), tmp_path / "cooldown")
    newest, want = df.agg(F.max("ts")).first()[0], []
    for key in ("a", "b"):
        acted = None
        for ts, urgent in rows(df.filter(F.col("entity_id") == key).select("ts", "is_emergency"), "ts"):
            if acted is None or (ts - acted).total_seconds() >= 60 * (7 if urgent else 15):
                acted = ts
                want.append((key, ts, urgent))
    want = [r for r in want if (newest - r[1]).total_seconds() >= 80 * 60]
    assert len(want) > 8 and rows(got, "entity_id", "ts") == want


@pytest.mark.parametrize("name", ["stream_observer", "stream_cycles", "stream_cooldown"])
def test_registered_streams_do_not_lose_readings(spark, readings, tmp_path, monkeypatch, name):
    """The query over files out of time order gives what it gives over one file."""
    import catalog
    from catalog import streams
    from catalog.registry import Tables

    df = readings[0].select("entity_id", "ts", "value", F.lit(1).cast("long").alias("site_id"))
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    sources = [spark.readStream.schema(df.schema).parquet(f"{tmp_path}/one"), feed_unordered(spark, df, f"{tmp_path}/in")]
    found = []
    for source in sources:
        monkeypatch.setattr(streams, "stream", lambda t: source)
        got = catalog.load()[name].run(Tables(spark, str(tmp_path)))
        found.append(rows(got, *got.columns[:2]))
    assert found[0] == found[1] and len(found[0]) > (2 * 150 - 1 if name == "stream_observer" else 1)


def test_resample_drops_late_rows(spark, readings, tmp_path):
    df, _ = readings
    late = df.filter("entity_id = 'a'").orderBy("ts").limit(1).withColumn("value", F.lit(1e6))
    source = feed(spark, df, f"{tmp_path}/in", late=late)
    got = drain(spark, live.stream_resample(source, S, "5 minutes", "10 minutes"), tmp_path)
    want = scan.resample_mean(df, S, "5 minutes")
    newest = df.agg(F.max("ts")).first()[0]
    # a bucket is out once the watermark, ten minutes behind the newest reading, has passed its end
    due = want.filter(F.col("bucket") + F.expr("INTERVAL 15 MINUTES") <= F.lit(newest))
    assert rows(got, "entity_id", "bucket") == rows(due.select(*got.columns), "entity_id", "bucket")


def test_cooldown(spark, minutes, tmp_path):
    df = minutes({"r": [0] * 40}).withColumn("is_emergency", F.minute("ts") >= 30)
    got = drain(spark, live.stream_cooldown(feed(spark, df, f"{tmp_path}/in", (0, 13, 40)), S, hold=False), tmp_path)
    assert [r[0].minute for r in rows(got.select("ts"), "ts")] == [0, 15, 30, 37]


def test_episode_sink_is_idempotent(spark, readings, tmp_path):
    df, _ = readings
    source = feed(spark, df, f"{tmp_path}/in").select("entity_id", "ts", "value")
    for _ in range(2):
        live.stream_episode_sink(source, f"{tmp_path}/ep", f"{tmp_path}/ckpt").awaitTermination()
    # as after a crash before the commit: the last batch runs again
    import glob
    import os

    last = max(glob.glob(f"{tmp_path}/ckpt/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    live.stream_episode_sink(source, f"{tmp_path}/ep", f"{tmp_path}/ckpt").awaitTermination()
    assert spark.read.json(f"{tmp_path}/ep").count() == df.count()
