"""Files in and out."""

import datetime as dt
import json

from conftest import rows
from pyspark.sql import functions as F

from wattloom.functions import scalar as fn
from wattloom.operators import scan
from wattloom.series import Series
from wattloom.sources import readers, sinks


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,value\n2024-01-01 00:00:00,1.5\n2024-01-01 00:01:00,\n")
    assert rows(readers.read_telemetry_csv(spark, str(tmp_path)), "ts") == [(ts("2024-01-01 00:00:00"), 1.5), (ts("2024-01-01 00:01:00"), None)]


def test_query_response(spark, tmp_path):
    body = {"results": [{"series": [{"name": "W", "columns": ["time", "value"], "values": [["2024-01-01T00:00:00Z", 100], ["2024-01-01T00:05:00Z", "unavailable"]]}, {"values": [["2024-01-01T00:00:00Z", 9]]}]}]}
    (tmp_path / "one.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "empty.json").write_text(json.dumps({"results": [{}]}))
    got = readers.read_query_response(spark, str(tmp_path)).drop("source")
    assert rows(got, "ts") == [(ts("2024-01-01 00:00:00"), 100.0), (ts("2024-01-01 00:05:00"), None)]


def test_state_records(spark, tmp_path):
    names = ["time", "current_temperature", "temperature", "fan_mode", "state", "hvac_action_str", "preset_mode_str"]
    body = {"results": [{"series": [{"columns": names, "values": [["2024-01-01T00:00:00Z", 20.5, 21, "auto", "heat", "heating", None]]}]}]}
    (tmp_path / "ac_kitchen.json").write_text(json.dumps(body))
    (r,) = readers.read_state_records(spark, str(tmp_path)).collect()
    assert tuple(r) == ("kitchen", ts("2024-01-01 00:00:00"), 20.5, 21.0, "auto", "heat", "heating")


def test_zone_versions(spark, tmp_path):
    names = "kind string, cluster_id long, power_mean double, power_std double, power_min double, power_max double, samples long"
    path = str(tmp_path / "zones")
    for day, low in (("2024-01-01", 900.0), ("2024-01-02", 1000.0)):
        sinks.write_zones(spark.createDataFrame([("unstable", 1, None, 150.0, low, 1500.0, 40)], names), path, day)
    assert readers.read_zones(spark, path).first().power_min == 1000.0
    assert readers.read_zones(spark, path, "2024-01-01").first().power_min == 900.0


def test_telemetry_layout_prunes_files(spark, tmp_path, minutes):
    path = str(tmp_path / "t")
    df = minutes({"a": range(3000), "b": range(3000)}).withColumn("measurement", F.lit("W"))
    sinks.write_telemetry(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 6000
    got = scan.scan_entity_range(back.filter("measurement = 'W' and day = '2024-01-02'"), "a", ts("2024-01-02 00:00:00"), ts("2024-01-02 00:05:00"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "EqualTo(entity_id,a)" in plan
    assert got.count() == 6


def test_autodetect_order(spark):
    df = spark.createDataFrame([("a", "kW", 1.0), ("a", "°C", 2.0), ("b", "state", 3.0), ("c", "other", 4.0)], "entity_id string, measurement string, value double")
    assert rows(scan.measurement_autodetect(df).select("entity_id", "value"), "entity_id") == [("a", 2.0), ("b", 3.0)]


def test_dedup(spark, minutes):
    df = minutes({"a": [1, 2]}).unionByName(minutes({"a": [3]}))
    assert [r[2] for r in rows(scan.dedup(df, Series()), "ts")] == [2.0, 2.0]


def test_scalars(spark):
    df = spark.createDataFrame([(0.0, "off"), (200.0, "heat"), (200.5, None), (5000.0, "unavailable"), (5001.0, "x"), (-1.0, "x"), (float("nan"), "x")], "p double, m string")
    got = df.select(fn.power_bin_right("p"), fn.power_band_left("p"), fn.is_on("m")).collect()
    assert [r[0] for r in got][:6] == ["0-200", "0-200", "200-400", "1800-5000", None, None]
    assert [r[1] for r in got][:6] == ["0-500", "0-500", "0-500", None, None, None]
    assert [r[2] for r in got][:5] == [False, True, True, False, True]
    assert df.select(fn.coerce_numeric("p")).collect()[6][0] is None
    text = spark.createDataFrame([("1.5",), ("unknown",), (None,)], "s string")
    assert [r[0] for r in text.select(fn.coerce_numeric("s")).collect()] == [1.5, None, None]


def test_available_features(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert scan.available_features(df, ["a", "b", "c"]) == ["a"]
