"""Substring dedup shuffles its texts once."""

import re

import pytest

from wattloom.llm import substrings


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("carry", [(), ("doc_id", "source")])
def test_substring_dedup_shuffles_texts_once(spark, tmp_path, no_broadcast, carry):
    same = " ".join(f"w{i}" for i in range(30))
    texts = [(1, f"a {same} b", "x"), (2, f"c {same} d", "y"), (2, "other text of the same id", "y"), (None, f"{same} e", None), (3, None, "z")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/docs")
    out = substrings.repeated_substrings(spark.read.parquet(f"{tmp_path}/docs"), window=10, carry=carry)
    got = {(r.doc_id, r.n_words): r.n_removed for r in out.collect()}
    assert got == {(1, 32): 30, (2, 32): 30, (2, 6): 0, (None, 31): 0, (3, 0): 0}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len([line for line in plan.splitlines() if re.search(r"ReusedExchange \[doc#\d+L?, own#\d+L?, text#", line)]) >= 1
