"""Text operators against brute force, on the smallest tables and on rows with nulls, ties and repeats."""

import collections
import functools
import hashlib
import math
import os
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connect, fetch  # noqa: E402

import corpus_pipeline  # noqa: E402
from wattloom.llm import counting, decontamination, fmindex, idstore, katz, language, neardup, packing, queries, repetition, substrings, urls  # noqa: E402
from wattloom.llm.tokens import PieceIds, tokenizer  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no id here"), (5, "A b C d E f"), (6, "a b c d e f"), (6, "a b c d e f"),
    (7, "x" * 50_000), (8, "tick tock " * 3_000), (9, "a  b \n c  <|endoftext|> d' 's 　 é́ \x1c q "), (10, "日本語 の 文 😀 " * 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    rows = [(i, t, None, i, "n") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, hit string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def given(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toArrow()
    assert compare(got, fetch(connect(FOLDER), queries.SQL[name])) == ""


# -- language -------------------------------------------------------------------------
def test_language_of_held_out_documents(spark):
    got = queries.op1_language_mixture(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id")
    held = got.where("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok")).collect()
    assert sum(r.ok for r in held) >= 0.97 * len(held)


def test_language_mixture_finds_shares():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.full(400, 0.2), 3).T
    counts = rng.multinomial(4000, 0.7 * p[:, 0] + 0.3 * p[:, 2])
    shares = language.select_languages(p, counts, 1.0)
    assert shares[1] == 0 and abs(shares[0] - 0.7) < 0.05
    assert language.select_languages(p, rng.multinomial(4000, p[:, 1]), 1.0).tolist() == [0, 1, 0]


def test_language_of_odd_rows(spark, docs, none, given):
    names, p = language.train(spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "de"), ("x", None)], "text string, lang string"))
    assert names == ["en", "fr"] and p.shape == (language.BUCKETS, 2)
    got = {r.doc_id: r for r in language.identify(docs, (names, p)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0
    assert language.identify(docs, (names, p)).count() == len(ODD) and language.identify(none, (names, p)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.train(none)).collect()} == {"und"}


# -- packing, counts, files -----------------------------------------------------------
@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_the_whole(vocabulary, given):
    texts = [t for _, t in ODD] + list(given.values())[:60]
    whole = [np.array(tokenizer(vocabulary).encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    ids = PieceIds(vocabulary, bound=500)
    assert list(ids.each(texts, chars=3_000)) == whole == list(ids.each(texts))


def test_fullest_against_all_subsets():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, 4)}
        used, first = packing.fullest(counts, 40), max(counts)
        sums = {first}
        for k, n in counts.items():
            sums |= {s + k * m for s in sums for m in range(n + 1 - (k == first)) if s + k * m <= 40}
        assert sum(k * v for k, v in used.items()) == max(sums) and all(v <= counts[k] for k, v in used.items())


def _check_packed(rows, texts, capacity, encode):
    want = [(k, [*encode(t or ""), 0]) for k, t in texts]
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append((r.start, np.frombuffer(r.ids, dtype="<u4").tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(s))])
        assert [o for o, _ in sorted(s)] == ends[:-1].tolist() and ends[-1] <= capacity
    for key in {(k, len(ids)) for k, ids in want}:
        joined = collections.Counter(i for _, ids in pieces[key] for i in ids)
        assert joined == collections.Counter(i for k, ids in want if (k, len(ids)) == key for i in ids)
    return sequences


def test_packing(spark, docs, none, given):
    encode = lambda t: tokenizer("byte_bpe_50k.json").encode(t, add_special_tokens=False).ids
    rows = packing.pack(docs, "byte_bpe_50k.json", 0, capacity=64, block_tokens=100).collect()
    _check_packed(rows, ODD, 64, encode)
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").coalesce(1)
    rows = packing.pack(table, "byte_bpe_50k.json", 0).collect()
    sequences = _check_packed(rows, given.items(), 1024, encode)
    assert sum(sum(n for _, n in s) < 1024 for s in sequences.values()) <= 1
    assert packing.pack(none, "byte_bpe_50k.json", 0).count() == 0


def test_token_counts(docs, none):
    encode = lambda t: tokenizer("word_bpe_49k.json").encode(t, add_special_tokens=False).ids
    got = counting.token_counts(docs, "word_bpe_49k.json", frequent=4, cache=3).collect()
    want = sorted((str(k), len((t or "").encode()), len(encode(t or ""))) for k, t in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert counting.token_counts(none, "word_bpe_49k.json").count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 62, 5_000).astype(np.uint64))
    index = idstore.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def test_id_store(spark, docs, none):
    encode = lambda t: tokenizer("word_bpe_49k.json").encode(t, add_special_tokens=False).ids
    path = idstore.new_store(spark)
    idstore.write_ids(docs, "word_bpe_49k.json", 2, path, shard_ids=60)
    store = idstore.open_store(spark, path)
    rows = idstore.global_starts(idstore.read_ids(store), store).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    texts = collections.defaultdict(list)
    for k, t in ODD:
        texts[k].append([*encode(t or ""), 2])
    assert all(np.frombuffer(r.ids, dtype="<u4").tolist() in texts[r.doc_id] for r in rows)
    assert idstore.lookup(spark, path, [4, 6, 9, 77]) == {4: texts[4], 6: texts[6], 9: texts[9]}
    path = idstore.new_store(spark)
    idstore.write_ids(none, "word_bpe_49k.json", 2, path)
    assert idstore.read_ids(idstore.open_store(spark, path)).count() == 0


# -- near-duplicates ------------------------------------------------------------------
def _components(texts, threshold):
    sets = []
    for k, t in texts:
        w = WORD.findall((t or "").translate(AZ))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    comp = {k: k for k, _ in texts}
    for i, (a, _) in enumerate(texts):
        for j in range(i):
            b, both = texts[j][0], len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * len(sets[i] | sets[j]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {k: new if v == old else v for k, v in comp.items()}
    return comp, {k: len(s) for (k, _), s in zip(texts, sets)}


@pytest.fixture(scope="module")
def copies():
    """Copies of a text with more and more words changed, in a group larger than a node, and other texts."""
    rng = np.random.default_rng(5)
    base, out = [f"w{x}" for x in rng.integers(0, 5_000, 150)], []
    for i in range(90):
        words = list(base)
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, 150))] = f"e{rng.integers(0, 9_000)}"
        out.append((100 + i, " ".join(words)))
    return out + [(300 + i, " ".join(f"v{x}" for x in rng.integers(0, 9_000, 60))) for i in range(20)]


def test_near_duplicates(spark, copies, none):
    texts = copies + [(i, t) for i, t in ODD if i and i != 6] + [(6, ODD[6][1])]
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    comp, sizes = _components(texts, 85)
    assert {k: r.component_id for k, r in got.items()} == comp and {k: r.n_shingles for k, r in got.items()} == sizes
    assert all(r.kept == (r.component_id == k) for k, r in got.items())
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_large_nodes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = []
    for group in range(3):  # chains: each text changes a word of the one before
        words = [f"w{group}x{k}" for k in range(120)]
        for k in range(60):
            words[int(rng.integers(0, 120))] = f"c{group}x{k}"
            texts.append((len(texts) + 1, " ".join(words)))
    for name, value in (("PART", 7), ("BLOCK", 3), ("PIVOTS", 2)):
        monkeypatch.setattr(neardup, name, value)
    monkeypatch.setattr(neardup, "branched", functools.partial(neardup.branched, small=3, depth=1))
    asked = []
    rest = neardup.rest_links
    monkeypatch.setattr(neardup, "rest_links", lambda *a: asked.append(rest(*a)) or asked[-1])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), trees=8).collect()}
    assert got == _components(texts, 85)[0]
    assert asked and asked[0].count() > 0


def test_near_duplicates_around_one_text(spark, threshold=80, shingles=360, changed=8):
    """Each copy is linked with the first text alone, just at the threshold, in nodes that stay large."""
    rng, step = np.random.default_rng(threshold), (shingles - 8) // changed
    base = [f"w{i}" for i in range(shingles + 4)]
    texts = [(0, " ".join(base))]
    for i in range(1, 2_001):
        words = list(base)
        for j in range(changed):  # five shingles each
            at = 4 + j * step + int(rng.integers(0, step - 4))
            words[at] = f"c{i}x{j}"
        texts.append((i, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(8), threshold=threshold).collect()
    assert len(got) == 2_001 and [r.doc_id for r in got if r.component_id != 0] == []


def test_near_duplicate_trees_follow_the_threshold():
    shapes = {t: neardup.shape(t) for t in (30, 50, 80, 85, 95)}
    assert all(neardup.missed(t, *s) <= 1e-6 for t, s in shapes.items())
    assert shapes[80][0] > shapes[85][0] > shapes[95][0]
    with pytest.raises(ValueError):
        neardup.shape(5)


def test_near_duplicates_of_odd_rows(docs):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id == 6} == {5}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


# -- substrings -----------------------------------------------------------------------
def test_fm_index_against_search():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 4, 300), 0)
    owner = np.sort(rng.integers(0, 9, 301))
    pattern = np.concatenate((text[40:90], rng.integers(1, 4, 30), text[200:240]))
    found = fmindex.LeastOwner(fmindex.FMIndex(text, 4, 8), owner, 7).match(pattern, np.array([0]), np.array([len(pattern)]), 99)
    for i in range(len(pattern)):
        places = [p for p in range(295) if i + 7 <= len(pattern) and (text[p : p + 7] == pattern[i : i + 7]).all() and len(text[p : p + 7]) == 7]
        assert found[i] == min((owner[p] for p in places), default=99)


def _cut(texts, window):
    first, words = {}, {}
    for k, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        words[k] = WORD.findall(t or "")
        for i in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][i : i + window]), k)
    out = {}
    for k, w in words.items():
        gone = {q for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != k for q in range(i, i + window)}
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("many", [2, 1_000])
def test_repeated_substrings(spark, copies, docs, none, many):
    texts = copies + ODD[:6] + [ODD[8], (401, "p " * 100 + "q"), (402, "z " + "p " * 70)]
    got = substrings.repeated_substrings(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), window=12, many=many, shard_words=500)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == _cut(texts, 12)
    assert substrings.repeated_substrings(docs, window=3).count() == len(ODD) and substrings.repeated_substrings(none).count() == 0


# -- decontamination ------------------------------------------------------------------
@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination(spark, docs, none, limit):
    items = [(1, "a b c d e f g h i j k l"), (2, "B, c D"), (2, "B, c D"), (3, None), (4, ""), (None, "h i"), (5, "tock tick tock tick tock tick tock tick tock tick")]
    texts = [*ODD, (20, "z z a b c d e f g h i j z"), (21, "b c x b c d"), (22, "h i")]
    rows = spark.createDataFrame([(k, t, 0) for k, t in texts], "doc_id long, text string, h int")
    bench = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, pos int")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in decontamination.contamination(rows, bench, broadcast_bytes=limit).collect():
        hit, ids = set(), set()
        for t in {t for k, t in texts if k == r.doc_id}:
            w = word.findall((t or "").translate(AZ))
            for k, x in items:
                x = word.findall((x or "").translate(AZ))
                n = min(len(x), 10)
                wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
                for i in range(len(w) - n + 1):
                    if n and tuple(w[i : i + n]) in wins:
                        hit |= set(range(i, i + n))
                        ids |= {str(k)} - {"None"}
        assert (set(r.hit), r.items) == (hit, sorted(ids))
    assert decontamination.contamination(rows, bench.limit(0)).where(F.size("hit") > 0).count() == 0
    assert decontamination.contamination(none, bench).count() == 0


def test_decontamination_judges_rows_without_an_id_alone(spark, monkeypatch):
    texts = [(None, "x a b c d e f g h i j y"), (None, "clean words here"), (None, None), (None, "clean words here"), (1, "more clean words")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.hit, r.items) for r in decontamination.contamination(rows, bench).collect()]
    assert sorted(got, key=repr) == sorted([(None, 12, list(range(1, 11)), ["1"]), (None, 3, [], []), (None, 0, [], []), (None, 3, [], []), (1, 3, [], [])], key=repr)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: bench)
    kept = corpus_pipeline.drop_contaminated(spark, rows, "").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(texts[1:], key=repr)


# -- language model -------------------------------------------------------------------
def _katz(texts):
    tokens = [(k, train, [*WORD.findall((t or "").translate(AZ)), "\n"]) for k, t, train in texts]
    c, b = collections.Counter(), collections.Counter()
    for _, train, w in tokens:
        if train:
            c.update(w)
            b.update(zip(["\0", *w[:-1]], w))
    total = sum(c.values())
    spread = lambda x: katz.discounts(np.array([collections.Counter(x.values())[i] for i in range(1, katz.ORDERS + 2)]))
    d1, d2 = spread(c), spread(b)
    less = lambda n, d: n * (d[n - 1] if n <= katz.ORDERS else 1.0)
    left = 1 - sum(less(n, d1) for n in c.values()) / total
    p1 = lambda w: less(c[w], d1) / total if c[w] else left
    mass, base = collections.Counter(), collections.Counter()
    for (h, w), n in b.items():
        mass[h] += less(n, d2)
        base[h] += p1(w)

    def p2(h, w):
        n = c["\n"] if h == "\0" else c[h]
        if not n:
            return p1(w)
        scale = n / (n + 1) if n - mass[h] < 1e-6 else 1
        return scale * less(b[h, w], d2) / n if b[h, w] else (1 - scale * mass[h] / n) / (1 - base[h]) * p1(w)

    out = []
    for k, _, w in tokens:
        add = sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in w)
        out.append((str(k), len(w), sum(c[x] > 0 for x in w), total, round(add, 6), round(sum(math.log10(p2(h, x)) for h, x in zip(["\0", *w[:-1]], w)), 6)))
    heads = [h for h in mass if h == "\0" or c[h]][:50]
    assert all(abs(sum(p2(h, w) for w in c) + p2(h, "\1") - 1) < 1e-9 for h in heads)
    return sorted(out)


def test_katz(spark, given, none):
    texts = [(k, t, zlib.crc32(str(k).encode()) % 7 != 2) for k, t in [*given.items(), *((1000 + i, t) for i, (_, t) in enumerate(ODD))]]
    got = katz.score(spark.createDataFrame(texts, "doc_id long, text string, learn boolean"), "learn", block_bytes=20_000).collect()
    rows = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    for a, b in zip(rows, _katz(texts), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-5)
    assert katz.score(none.withColumn("learn", F.lit(True)), "learn").count() == 0
    unknown = katz.score(spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, learn boolean"), "learn").first()
    assert (unknown.n_known, unknown.train_tokens, unknown.score) == (0, 0, 0)


# -- rules ----------------------------------------------------------------------------
def test_suffix_array():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 40, 200):
        words = rng.integers(0, 3, n)
        lengths = repetition.repeat_lengths(words)
        s = words.tolist()
        want = [max((k for k in range(n - i + 1) if any(s[j : j + k] == s[i : i + k] and j + k <= n for j in range(n) if j != i)), default=0) for i in range(n)]
        assert lengths.tolist() == want


def test_repetition_of_odd_rows(docs, none):
    got = {r.doc_id: r for r in repetition.quality(docs, block_words=3).collect()}
    assert (got[1].n_words, got[1].edges, got[1].base_failed) == (0, [], True)
    assert got[8].longest_repeat == 5_998 and got[8].edges == [0, 6_000] and not got[8].kept
    assert repetition.quality(docs).count() == len(ODD) and repetition.quality(none).count() == 0


def test_url_rules(spark):
    urls_ = [None, "", "x.org/a", "http://A.ORG/x", "http://a.example.org/es/1", "http://example.org/en/12", "http://org", "ftp://b.com/fr/?q", "http://fr.spam-farm.net/", "http://example.net/a"]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(10)] == [None, None, None, "org/", "example.org/es/", "example.org/en/1", None, "com/fr/", None, None]
    assert [got[i].verdict for i in range(10)] == ["allow"] * 4 + ["block"] * 2 + ["allow"] * 2 + ["block", "allow"]
    assert (got[3].host, got[3].path, got[6].path, got[2].host) == ("a.org", "/x", "", "")


# -- pipeline -------------------------------------------------------------------------
def test_pipeline_stages(spark, given):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
        kept[name] = (before, {r.doc_id: r.text for r in docs.collect()})
    before, after = kept["near_duplicates"]
    comp, _ = _components(sorted(before.items()), 80)
    assert set(after) == {k for k, c in comp.items() if c == k}
    before, after = kept["repeated_passages"]
    cut = _cut(before.items(), 50)
    want = {k: (cut[k][2] if cut[k][1] else t) for k, t in before.items() if cut[k][2] or not cut[k][1]}
    assert after == want
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
