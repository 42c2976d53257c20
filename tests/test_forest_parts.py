"""Trees are grown on even partitions, however uneven the partitions of the features are."""

import types

from pyspark.sql import functions as F

from wattloom.operators import ml


def sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_of_a_partition(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ml, "PART_ROWS", 100, raising=False)
    monkeypatch.setattr(ml, "forest", lambda *a, **k: types.SimpleNamespace(fit=lambda df: seen.append((sizes(df), df.count(), df.agg(F.sum("x")).first()[0]))))
    df = spark.range(3000, numPartitions=1).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("target"))
    for balanced in (True, False):
        ml._fit(df, ["x"], "target", 2, 2, 1, balanced)
    for parts, n, total in seen:
        assert n == 3000 and total == sum(range(3000))
        # the rows are dealt: a partition differs from the mean by little
        assert max(parts) <= 110 and len(parts) >= 30
    assert len(seen) == 2


def test_few_rows_stay(spark):
    df = spark.range(300).withColumn("y", F.lit(1))
    assert ml.spread(df, 300) is df
