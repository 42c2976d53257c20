"""Registered queries of the text operators, with production parameters, and the SQL that can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import centroids, counting, decontamination, idstore, katz, language, neardup, packing, repetition, substrings, urls, warc, whitening
from wattloom.llm import sql as oracle
from wattloom.llm.common import shared_path, table

BYTE_BPE, BYTE_BPE_END = "byte_bpe_50k.json", 0
WORD_BPE, WORD_BPE_END = "word_bpe_49k.json", 2


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out("doc_id"))
    model = language.train(docs.where(~F.col("held_out")))
    return language.identify(docs, model, carry=("doc_id", "held_out"))


def op2_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, BYTE_BPE_END)
    digest = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset", "padded_length")


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = counting.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = idstore.new_store(spark)
    idstore.write_ids(table(spark, sf_dir, "documents"), WORD_BPE, WORD_BPE_END, path)
    store = idstore.open_store(spark, path)
    rows = idstore.read_ids(store).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return idstore.global_starts(rows, store).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.repeated_substrings(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("learn", ~language.held_out("doc_id", 7))
    scored = katz.score(docs, "learn")
    return scored.withColumn("held_out", ~F.col("train")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words"
    )


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op11_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    index = warc.write_archives(warc.classify(table(spark, sf_dir, "pages")), path)
    return warc.read_archives(index, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    whole = {c: F.expr(f"try_cast({c} AS bigint)") for c in ("distance", "cluster_inertia", "inertia")}
    return found.withColumns(whole).withColumn("centroid_sha256", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)).drop("centroid")


QUERIES = {
    f.__name__: f
    for f in (op1_language_mixture, op2_slack_packing, op3_chosen_path, op4_token_counts, op5_id_store, op6_fm_index, op7_winnowing, op8_katz, op9_repetition, op10_url_rules, op11_block_whitening, op12_dictionary_warc, op13_shallot)
}
QUERIES["pipeline"] = corpus_pipeline.run
SQL = {"op3_chosen_path": oracle.NEAR_DUPLICATES, "op6_fm_index": oracle.SUBSTRINGS, "op7_winnowing": oracle.WINNOWING, "op9_repetition": oracle.REPETITION, "op10_url_rules": oracle.URL_RULES, "op12_dictionary_warc": oracle.WARC, "op13_shallot": oracle.CLUSTERS}
