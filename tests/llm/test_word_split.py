"""Words of the decontamination are what lies between separators."""

import re

from pyspark.sql import functions as F

from wattloom.llm import decontamination


def test_words_are_split_not_matched_one_by_one(spark):
    texts = ["", " ", "A", "one, two;;three\x00x", "Ünder ÉTÉ über-Ärger 1st 日本 x", None, "\x7fa\x7f", "ÀB c 𝔸X"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decontamination.words(F.col("t")).alias("ws"))
    low = str.maketrans(decontamination.UPPER, decontamination.LOWER)
    assert {r.t: r.ws for r in df.collect()} == {t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low)) for t in texts}
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
