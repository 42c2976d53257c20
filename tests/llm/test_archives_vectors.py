"""Whitening, WARC archives and bounded k-means against brute force, on odd rows and on files read without Spark."""

import hashlib
import io
import os
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from wattloom.llm import centroids, queries, vectors, warc, whitening
from wattloom.llm.common import shared_path

FOLDER = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")
VECTORS = [
    (1, [0.5, 1.0, -2.0]), (2, [0.5, 1.0, -2.0]), (None, [0.1, 1.5, 3.0]), (3, None), (4, []), (5, [NAN, 1.0, 2.0]), (6, [None, 1.0, 1.0]),
    (7, [1.0, 2.0]), (8, [INF, 1.0, 1.0]), (1, [1.25, 1.5, 0.0]), (9, [-1.25, 2.5, 0.75]), (9, [-1.25, 2.5, 0.75]), (10, [3.0, -2.5, 0.75]),
]


def frame(spark, rows, extra="x", kind="double"):
    """With a column whose name the operators use themselves."""
    return spark.createDataFrame([(i, v, "own") for i, v in rows], f"vec_id long, embedding array<{kind}>, {extra} string")


def units(rows, width, scale=64, shift=0):
    out = []
    for i, v in rows:
        if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v):
            out.append((i, [int(np.floor(np.float64(c) * scale)) + shift for c in v]))
    return out


# -- whitening ------------------------------------------------------------------------
def check_whitening(got, kept, k=16):
    x = np.array([v for _, v in kept], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-12 * e[0]).sum()))
    white = (x - total / n) @ v[:, :k] / np.sqrt(e[:k])
    want = {}
    for (i, _), row, w in zip(kept, x, white):
        want.setdefault((i, int(((n * row - total) ** 2).sum())), []).append(tuple(np.round(np.abs(w), 8)))
    rows = {}
    for r in sorted(got, key=lambda r: r.component):
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) <= 1e-4
        rows.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(round(abs(r.whitened), 8))
    assert set(rows) == set(want)
    for key, by in rows.items():
        assert sorted(by) == list(range(1, k + 1))
        for c in by:
            np.testing.assert_allclose(sorted(by[c]), sorted(w[c - 1] for w in want[key]), atol=1e-6)


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check_whitening(queries.op11_block_whitening(spark, FOLDER).collect(), units(rows, 64, shift=1_000_000))


@pytest.mark.parametrize("block, panel", [(2, 2), (3, 100), (1, 1), (2048, 32_768)])
def test_whitening_of_odd_rows(spark, block, panel):
    got = whitening.whiten(frame(spark, VECTORS).repartition(3), rows_per_block=block, panel_blocks=panel).collect()
    check_whitening(got, units(VECTORS, 3, shift=1_000_000))


def test_whitening_has_one_sign_for_all_rows(spark):
    got = whitening.whiten(frame(spark, VECTORS), components=1).orderBy("vec_id").collect()
    x = np.array([v for _, v in units(VECTORS, 3)])
    fit = np.unique(x, axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    want = (x - fit.mean(axis=0)) @ v[:, -1] / np.sqrt(e[-1])
    values = sorted(r.whitened for r in got)
    assert np.allclose(values, sorted(want)) or np.allclose(values, sorted(-want))


def test_whitening_without_variance(spark):
    df = frame(spark, VECTORS)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id IN (1, 2) AND embedding[0] = 0.5")).count() == 0
    assert whitening.whiten(df.where("vec_id IN (3, 4, 5, 6, 8)")).count() == 0


def test_whitening_of_entries_beyond_doubles(spark):
    rows = [(1, [1e300, 1.0]), (2, [3.0, -1e300]), (3, [0.0, 0.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    top = 1 << 53
    x = [[top + 1_000_000, 64 + 1_000_000], [192 + 1_000_000, 1_000_000 - top], [1_000_000, 1_000_000]]
    total = [sum(c) for c in zip(*x)]
    want = {i + 1: sum((3 * c - t) ** 2 for c, t in zip(row, total)) for i, row in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in got} == want


def test_sums_are_exact_and_per_group(spark):
    rows = [(0, [2**62, 1]), (0, [2**62, -1]), (1, [-5, 7])]
    df = spark.createDataFrame(rows, "g long, x array<long>").repartition(2)
    got = {r.g: (r.n, [int(v) for v in r.sums]) for r in vectors.sums(df, "x", 2, "g").collect()}
    assert got == {0: (2, [2**63, 0]), 1: (1, [-5, 7])}


# -- WARC -----------------------------------------------------------------------------
LONG, OTHER = "<p>" + "copied " * 30, "<p>" + "other " * 40
PAGES = [
    (5, "http://a/5", LONG), (3, "http://a/3 x\r\ny", LONG), (9, None, LONG), (None, "http://a/n", LONG), (4, "http://a/4", OTHER), (4, "http://a/4", OTHER),
    (8, "http://a/8", OTHER), (6, "http://a/6", "tiny"), (7, "http://a/7", "tiny"), (1, "http://a/1", None), (2, "http://a/2", ""),
    (10, "http://a/ä", "ä" * 50), (11, "http://a/11", "ä" * 50), (12, "http://a/12", "x" * 3_000_000), (13, "http://a/13", "\r\n\r\nWARC/1.1 \x00" * 20),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "own") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)


def archived(spark, df, **options):
    path = shared_path(spark, "warc-test")
    return path, warc.write_archives(warc.classify(df), path, **options)


@pytest.mark.parametrize("size", [1, 500, 32 << 20])
def test_archives_of_odd_pages(spark, pages, size):
    path, index = archived(spark, pages, archive_bytes=size)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in warc.read_archives(index, path).collect()), key=repr)
    want = []
    for i, _, body in PAGES:
        data = (body or "").encode()
        named = [p for p, _, b in PAGES if b == body and p is not None]
        first = min(named) if len(data) >= 100 and named else i
        revisit = i != first
        want.append((i, "revisit" if revisit else "response", first if revisit else None, len(data), hashlib.sha256(data).hexdigest(), None if revisit else data))
    assert [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got] == sorted(want, key=repr)


def test_pages_without_any_id_and_empty_table(spark, pages):
    path, index = archived(spark, pages.where("page_id IS NULL").unionByName(pages.where("page_id IS NULL")))
    assert [(r.page_id, r.record_type) for r in warc.read_archives(index, path).collect()] == [(None, "response")] * 2
    path, index = archived(spark, pages.limit(0))
    assert warc.read_archives(index, path).count() == 0


def test_archive_format(spark):
    """A folder's files read by the format alone: skippable frame, dictionary, one frame a record at the index's places."""
    path, index = archived(spark, spark.read.parquet(f"{FOLDER}/pages.parquet"), archive_bytes=1 << 30)
    rows = index.orderBy("archive", "offset").collect()
    assert len(rows) == 50
    for name in {r.archive for r in rows}:
        data = open(os.path.join(path.removeprefix("file://"), name), "rb").read()
        mine = [r for r in rows if r.archive == name]
        magic, length = struct.unpack("<II", data[:8])
        if len(mine) >= 8:
            assert magic == 0x184D2A5D and mine[0].offset == 8 + length
            words = zstandard.ZstdDecompressor().decompress(data[8 : 8 + length])
            assert words[:4] == b"\x37\xa4\x30\xec"
            z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            with pytest.raises(zstandard.ZstdError):
                zstandard.ZstdDecompressor().decompress(data[mine[0].offset : mine[0].offset + mine[0].length])
        else:
            z = zstandard.ZstdDecompressor()
        assert mine[-1].offset + mine[-1].length == len(data)
        for r in mine:
            text = z.decompress(data[r.offset : r.offset + r.length])
            assert text == warc.read_record(io.BytesIO(data), r.offset, r.length)
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
            assert warc.parse(text)["page_id"] == str(r.page_id)


def test_dictionary_saves_space():
    records = [b"<html><head><title>page %d</title></head><body class='standard layout'>" % i + os.urandom(20) for i in range(500)]
    with_, without = io.BytesIO(), io.BytesIO()
    warc.write_archive(with_, records, size=4096)
    warc.write_archive(without, records, size=0)
    assert list(warc.read_archive(io.BytesIO(with_.getvalue()))) == list(warc.read_archive(io.BytesIO(without.getvalue()))) == records
    assert len(with_.getvalue()) < 0.8 * len(without.getvalue())


def test_broken_archives_are_errors():
    out = io.BytesIO()
    row = {"page_id": 1, "url": None, "payload": b"body", "digest": hashlib.sha256(b"other").hexdigest(), "first": None, "first_url": None}
    warc.write_archive(out, [warc.record(row, "2024-01-01T00:00:00Z")])
    with pytest.raises(ValueError, match="another payload"):
        warc.parse(next(warc.read_archive(io.BytesIO(out.getvalue()))))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_archive(io.BytesIO(out.getvalue()[:-5])))


# -- k-means --------------------------------------------------------------------------
def lloyd(kept, k, rounds):
    """By comparing every vector with every centroid."""
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [list(v) for _, v in named[:k]]
    if not c:
        return []

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, g) in zip(kept, found) if g == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    inertia = [sum(d for d, g in found if g == j) for j in range(len(c))]
    return sorted(((i, g, d, inertia[g], sum(inertia), c[g]) for (i, _), (d, g) in zip(kept, found)), key=repr)


def clustered(df, **options):
    return sorted(((r.vec_id, r.cluster, int(r.distance), int(r.cluster_inertia), int(r.inertia), r.centroid) for r in centroids.cluster(df, **options).collect()), key=repr)


@pytest.mark.parametrize("k, rounds", [(1, 2), (2, 0), (4, 3), (16, 3)])
def test_clusters_of_odd_rows(spark, k, rounds):
    assert clustered(frame(spark, VECTORS).repartition(3), width=3, k=k, rounds=rounds) == lloyd(units(VECTORS, 3), k, rounds)


def test_clusters_with_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) / 64 for v in rng.integers(-2, 3, 2)]) for i in range(300)] + [(i, [0.0, 0.0]) for i in range(300, 500)] + [(7, [0.0, 0.0])] * 3
    assert clustered(frame(spark, rows).repartition(4), width=2, k=7, rounds=6) == lloyd(units(rows, 2), 7, 6)


def test_clusters_beyond_64_bits(spark):
    rows = [(i, [s * 2.0**e, float(i)]) for i, (s, e) in enumerate([(1, 60), (-1, 60), (1, 40), (-1, 30), (1, 3), (0, 0)])]
    kept = [(i, [max(-(1 << 53), min(1 << 53, int(v[0] * 64))), int(v[1] * 64)]) for i, v in rows]
    assert clustered(frame(spark, rows), width=2, k=3, rounds=3) == lloyd(kept, 3, 3)


def test_clusters_of_nothing(spark):
    df = frame(spark, VECTORS)
    assert centroids.cluster(df.limit(0), width=3).count() == 0
    assert centroids.cluster(df, width=9).count() == 0
    assert centroids.cluster(df.where("vec_id IS NULL"), width=3).count() == 0


def test_search_is_exact_and_saves_distances():
    """Rounds of moving centroids: the remembered bounds never change a result, and most distances are not computed."""
    rng = np.random.default_rng(5)
    means = rng.normal(0, 400, (24, 8))
    x = np.floor(means[rng.integers(0, 24, 4000)] + rng.normal(0, 40, (4000, 8))).astype(np.int64)
    c = x[rng.choice(4000, 24, replace=False)]
    state, moved, spent = (np.zeros(4000, dtype=np.int64), np.ones(4000, dtype=np.int64), np.full(4000, np.inf), np.zeros(4000)), None, 0
    for _ in range(8):
        *state, count = centroids.search(x, centroids.Centroids(c, moved), *state)
        spent += count
        full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (state[0] == full.argmin(axis=1)).all()
        true = np.sqrt(np.sort(full, axis=1))
        assert (state[2] >= true[:, 0]).all() and (state[3] <= true[:, 1]).all()
        new = np.array([np.floor(x[state[0] == j].mean(axis=0)).astype(np.int64) if (state[0] == j).any() else c[j] for j in range(24)])
        moved, c = np.sqrt(((new - c) ** 2).sum(axis=1)), new
    assert spent < 0.35 * 8 * 4000 * 24


def test_state_of_equal_centroids():
    x = np.array([[1, 1], [2, 2], [5, 5]], dtype=np.int64)
    c = centroids.Centroids(np.array([[2, 2], [2, 2], [1, 1]], dtype=np.int64))
    first, *_ = centroids.search(x, c, np.zeros(3, dtype=np.int64), np.ones(3, dtype=np.int64), np.full(3, INF), np.zeros(3))
    assert first.tolist() == [2, 0, 0]


def test_ids_are_not_collected(spark):
    """The query's result has every kept row."""
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    got = queries.op13_shallot(spark, FOLDER)
    assert got.count() == df.count() and got.agg(F.countDistinct("centroid_sha256")).first()[0] <= 16
