"""Rows that share an id but not the text, and columns with names that stages might use themselves."""

import hashlib

import corpus_pipeline
import pytest
from wattloom.llm import substrings

FOLDER = "/root/testdata/sf0.001"


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


LONG = words("a", 60)
ROWS = [(1, LONG), (2, words("b", 100) + " " + LONG), (2, "short text"), (2, words("c", 30) + " " + LONG + " " + words("d", 5)), (3, LONG), (3, LONG), (None, LONG), (4, None), (5, "")]


def brute(rows, window=50):
    """kept text and number of words removed of each row, by the definition."""
    first = {}
    for i, t in rows:
        ws = (t or "").split()
        for p in range(len(ws) - window + 1):
            key, doc = tuple(ws[p : p + window]), -1 << 63 if i is None else i
            first[key] = min(first.get(key, doc), doc)
    out = []
    for i, t in rows:
        ws, gone = (t or "").split(), set()
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p : p + window])] < (-1 << 63 if i is None else i):
                gone |= set(range(p, p + window))
        out.append((i, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("many, shard", [(4000, 1_000_000), (1, 1), (4000, 40)])
def test_passages_are_cut_from_their_own_row(spark, many, shard):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = substrings.repeated_substrings(df, many=many, shard_words=shard).select("doc_id", "n_words", "n_removed", "kept_text")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS)


@pytest.fixture(scope="module")
def odd(spark):
    """Clashing names, two texts of one id, repeated rows, a row without an id."""
    names = ["_row", "_kept", "_cut", "_own", "row", "kept", "cut_text", "hashed", "gone", "text_key", "hit_key", "doc", "own", "stop"]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    rows = [*ROWS, (7, item), (7, words("clean", 80)), (None, item), (None, words("other", 70))]
    data = [(i, t, 0, *[f"{n}{j}" for n in names]) for j, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, n_chars int, {', '.join(f'{n} string' for n in names)}").repartition(2).persist()


def values(df):
    return sorted(((r.doc_id, r.text, r._row, r.hit_key) for r in df.collect()), key=repr)


def test_stages_keep_columns_and_rows(spark, odd):
    every = values(odd)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns, name
        assert set(r[2] for r in values(out)) <= set(r[2] for r in every)
        assert stage(spark, odd.limit(0), FOLDER).count() == 0


def test_near_duplicates_keep_other_texts_of_an_id(spark, odd):
    got = [(r[0], r[1]) for r in values(corpus_pipeline.drop_near_duplicates(spark, odd, FOLDER))]
    texts = {t for i, t in got if i == 7}
    assert len(texts) == 2 and (1, LONG) in got and (3, LONG) not in got
    assert (None, LONG) in got and (4, None) in got and (5, "") in got


def test_cut_rows_are_not_multiplied(spark, odd):
    got = values(corpus_pipeline.cut_repeated_passages(spark, odd, FOLDER))
    cut = {(r.doc_id, r.text) for r in odd.collect()}
    want = sorted((i, kept) for i, n, gone, kept in brute(list(cut)) if i == 2)
    assert sorted((r[0], r[1]) for r in got if r[0] == 2) == want
    # both rows of document 3 lose everything
    assert not [r for r in got if r[0] == 3] and len([r for r in got if r[0] is None]) == 3


def test_contamination_judges_each_row(spark, odd):
    got = {(r[0], r[1]) for r in values(corpus_pipeline.drop_contaminated(spark, odd, FOLDER))}
    assert (7, words("clean", 80)) in got and (None, words("other", 70)) in got
    assert len([g for g in got if g[0] == 7]) == 1 and len([g for g in got if g[0] is None]) == 2


def test_language_stage_keeps_clashing_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = corpus_pipeline.identify_language(spark, docs.withColumn("row", docs["source"]), FOLDER)
    assert got.columns == [*docs.columns, "row"]
    plain = {(r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) for r in docs.collect()}
    kept = got.collect()
    assert {(r.doc_id, hashlib.md5(r.text.encode()).hexdigest()) for r in kept} <= plain and all(r.row == r.source for r in kept)
