"""Models of each key: against plain rounds over all rows, alone and together, in one part and in many."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import clusters, models
from wattloom.plans import analysis
from wattloom.series import Series

LEVELS = {"a": [(100, 10), (500, 25), (1500, 90)], "b": [(300, 20), (2000, 40)], "c": [(50, 5), (400, 5), (900, 30), (1800, 60)]}


def cloud(key, n=400):
    rng = random.Random(key)
    rows = []
    for i in range(n):
        m, sd = rng.choice(LEVELS[key])
        # many equal points, as meters have
        rows.append((key, i, float(round(rng.gauss(m, sd))), float(round(rng.gauss(sd, sd / 4)))))
    return rows


@pytest.fixture(scope="module")
def rows():
    return {k: cloud(k) for k in LEVELS}


@pytest.fixture(scope="module")
def table(spark, rows):
    every = [r for k in rows for r in rows[k]] + [("few", i, float(i), 1.0) for i in range(5)] + [("a", 1000, None, 3.0)]
    return spark.createDataFrame(every, "key string, i int, p double, sd double").repartition(5).persist()


def read(fitted):
    return {(r.key, r.k, r.restart): r for r in fitted.collect()}


@pytest.fixture(scope="module")
def mixed(table):
    return read(models.mixtures(table, ["key"], ["p", "sd"], [2, 3, 4], restarts=3, min_rows=100))


def test_all_candidates_and_short_keys(mixed):
    assert {(k, n, r) for k, n, r in mixed if k != "few"} == {(k, n, r) for k in LEVELS for n in (2, 3, 4) for r in range(3)}
    short = [m for (k, _, _), m in mixed.items() if k == "few"]
    assert [(m.status, m.n, m.k, m.components) for m in short] == [("too_few_rows", 5, None, None)]
    for key in LEVELS:
        own = [m for (k, _, _), m in mixed.items() if k == key]
        best = [m for m in own if m.best]
        assert len(best) == 1 and best[0].bic == min(m.bic for m in own)
        assert best[0].k == len(LEVELS[key]) and best[0].n == 400


def density(x, m):
    out = []
    for c in m.components:
        cov = np.array(c.cov).reshape(2, 2)
        off = x - np.array(c.mean)
        quad = np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov), off)
        out.append(math.log(c.weight) - math.log(2 * math.pi) - 0.5 * math.log(np.linalg.det(cov)) - 0.5 * quad)
    return np.array(out).T


def test_scores_and_fixed_points(rows, mixed):
    """Scores belong to the returned parameters, and another round over all rows gains next to nothing."""
    for (key, k, _), m in mixed.items():
        if key == "few":
            continue
        x = np.array([r[2:] for r in rows[key]])
        std = x.std(axis=0)
        p = density(x, m)
        score = np.logaddexp.reduce(p, axis=1)
        # scores are those of standardised columns
        assert m.score == pytest.approx(score.sum() + len(x) * np.log(std).sum(), rel=1e-9)
        assert m.bic == pytest.approx(-2 * m.score + (k - 1 + 2 * k + 3 * k) * math.log(len(x)), rel=1e-12)
        r = np.exp(p - score[:, None])
        means = r.T @ x / r.sum(axis=0)[:, None]
        cov = np.array([(r[:, j, None] * (x - means[j])).T @ (x - means[j]) / r[:, j].sum() for j in range(k)]) + 1e-6 * np.diag(std**2)
        new = np.array([math.log(w) for w in r.mean(axis=0)])
        q = np.array([new[j] - math.log(2 * math.pi) - 0.5 * math.log(np.linalg.det(cov[j])) - 0.5 * np.einsum("ni,ij,nj->n", x - means[j], np.linalg.inv(cov[j]), x - means[j]) for j in range(k)]).T
        assert np.logaddexp.reduce(q, axis=1).sum() - score.sum() < 2e-3 * len(x)


def close(a, b):
    assert (a.status, a.k, a.restart, a.best) == (b.status, b.k, b.restart, b.best)
    if a.score is not None:
        assert a.score == pytest.approx(b.score, rel=1e-9)
    for x, y in zip(a.components or [], b.components or []):
        assert x.mean == pytest.approx(y.mean, rel=1e-7) and x.cov == pytest.approx(y.cov, rel=1e-6, abs=1e-6)


def test_a_key_alone_has_the_same_model(table, mixed):
    alone = read(models.mixtures(table.filter("key = 'a'"), ["key"], ["p", "sd"], [2, 3, 4], restarts=3, min_rows=100))
    assert len(alone) == 9
    for name, m in alone.items():
        close(m, mixed[name])


def test_parts_do_not_change_models(table, mixed, monkeypatch):
    monkeypatch.setattr(models, "PART_ROWS", 90)
    dealt = read(models.mixtures(table.filter("key <> 'c'"), ["key"], ["p", "sd"], [2, 3, 4], restarts=3, min_rows=100))
    assert set(dealt) == {name for name in mixed if name[0] != "c"}
    for name, m in dealt.items():
        close(m, mixed[name])


def test_rounds_end(table, monkeypatch):
    monkeypatch.setattr(models, "PART_ROWS", 90)
    got = read(models.k_means(table.filter("key = 'c'"), ["key"], ["p", "sd"], 4, restarts=2, max_rounds=1))
    assert all(m.score > 0 for m in got.values())


def lloyd_inertia(x, means):
    return ((x[:, None] - means[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_k_means_of_each_key(table, rows):
    fitted = models.k_means(table, ["key"], ["p", "sd"], lambda n: len(LEVELS["c"]) if n > 100 else 2, restarts=4, min_rows=3)
    got = read(fitted)
    for (key, k, _), m in got.items():
        if key == "few":
            assert m.k == 2 and m.status == "ok"
            continue
        x = np.array([r[2:] for r in rows[key]])
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        means = (np.array([c.mean for c in m.components]) - x.mean(axis=0)) / x.std(axis=0)
        assert m.score == pytest.approx(lloyd_inertia(z, means), rel=1e-9)
        near = ((z[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([z[near == j].mean(axis=0) for j in range(k)])
        assert ((moved - means) ** 2).sum() <= 1e-4
    labelled = models.label(table, ["key"], ["p", "sd"], fitted).collect()
    for r in labelled:
        if r.p is None:
            assert r.cluster is None
    best = {m.key: m for m in got.values() if m.best}
    for key in LEVELS:
        x = np.array([r[2:] for r in rows[key]])
        means, std = np.array([c.mean for c in best[key].components]), x.std(axis=0)
        want = {r[1]: int((((np.array(r[2:]) - means) / std) ** 2).sum(axis=1).argmin()) for r in rows[key]}
        assert {r.i: r.cluster for r in labelled if r.key == key and r.p is not None} == want


def test_labels_of_mixtures(table, rows, mixed):
    labelled, scores = clusters.gmm_bic_select(table, ["p", "sd"], [2, 3, 4], ["key"], min_rows=100)
    best = {m.key: m for m in mixed.values() if m.best}
    got = labelled.collect()
    for key in LEVELS:
        x = np.array([r[2:] for r in rows[key]])
        want = density(x, best[key]).argmax(axis=1)
        own = {r.i: r.cluster for r in got if r.key == key and r.p is not None}
        assert [own[r[1]] for r in rows[key]] == want.tolist()
        assert sorted(c.mean[0] for c in best[key].components) == [c.mean[0] for c in best[key].components]
    assert all(r.cluster is None for r in got if r.key == "few" or r.p is None)
    assert scores.filter("key = 'few'").first().status == "too_few_rows"


def test_constant_columns_and_single_points(spark):
    df = spark.createDataFrame([("x", 5.0, 1.0)] * 30 + [("y", float(i % 2), 7.0) for i in range(40)], "key string, p double, sd double")
    got = read(models.mixtures(df, ["key"], ["p", "sd"], [2], restarts=2))
    assert all(math.isfinite(m.bic) and sum(c.weight for c in m.components) == pytest.approx(1) for m in got.values())
    assert [c.mean[0] for c in got["y", 2, 0].components] == pytest.approx([0, 1], abs=1e-6)
    km = read(models.k_means(df, ["key"], ["p", "sd"], 3, restarts=2))
    assert all(m.score == pytest.approx(0, abs=1e-9) for m in km.values())


def test_no_rows(spark):
    df = spark.createDataFrame([], "key string, p double, sd double")
    assert models.mixtures(df, ["key"], ["p", "sd"], [2]).count() == 0


def test_without_keys_all_rows_share_a_model(table):
    labelled, scores = clusters.gmm_bic_select(table.filter("key = 'b'"), ["p", "sd"], [2])
    assert labelled.columns == [*table.columns, "cluster"] and "key" not in scores.columns
    got = {r.cluster: r.p for r in labelled.groupBy("cluster").agg(F.avg("p").alias("p")).collect()}
    assert got[0] == pytest.approx(300, abs=10) and got[1] == pytest.approx(2000, abs=20)


# -- whole analyses ---------------------------------------------------------------------
@pytest.fixture(scope="module")
def two(minutes):
    rng = random.Random(7)
    steady = [rng.gauss(600, 5) if (i // 240) % 2 else rng.gauss(1600, 10) for i in range(7200)]
    return minutes({"long": steady, "short": [500.0] * 60})


def test_zones_of_each_key(two):
    options = dict(n=10, min_rows=500, restarts=2)
    got = analysis.learn_zones(two, Series(slice="1 day"), **options).collect()
    by = {}
    for r in got:
        by.setdefault(r.entity_id, []).append(r)
    assert {r.status for r in by["short"]} == {"too_few_rows"}
    assert sorted(r.power_mean for r in by["short"] if r.kind == "stable") == [500.0, 1800.0]
    assert {r.status for r in by["long"]} == {"ok"}
    stable = sorted(r.power_mean for r in by["long"] if r.kind == "stable")
    assert any(abs(m - 600) < 10 for m in stable) and any(abs(m - 1600) < 10 for m in stable)
    alone = analysis.learn_zones(two.filter("entity_id = 'long'"), Series(slice="1 day"), **options).collect()
    key = lambda r: (r.cluster_id, r.kind, r.samples, round(r.power_std, 6))
    assert sorted(map(key, alone)) == sorted(map(key, by["long"]))


def test_a_long_key_does_not_decide_for_a_short_one(two):
    from wattloom.operators.zones import stability_metrics

    got = analysis.regions_by_kmeans(stability_metrics(two, Series(slice="1 day")), ["entity_id"], restarts=2).collect()
    assert {(r.entity_id, r.method) for r in got} == {("long", "kmeans"), ("short", "bins")}
    assert max(r.power_avg for r in got if r.entity_id == "short") == 500.0


@pytest.mark.parametrize("name, sizes", [("learn_zones", (2, 5)), ("retrain_zones_daily", (2, 5)), ("gmm_bic_select", (2, 7)), ("gmm_labels", (2, 7))])
def test_registered_mixtures_search_all_components(spark, monkeypatch, name, sizes):
    """Each query tries every number of components asked for, from three starts, for every series."""
    import catalog
    from catalog.registry import Tables

    class Stop(Exception):
        pass

    asked = []

    def stop(df, keys, cols, ks, restarts=3, **options):
        asked.append((list(keys), list(ks), restarts))
        raise Stop

    monkeypatch.setattr(models, "mixtures", stop)
    with pytest.raises(Stop):
        catalog.load()[name].run(Tables(spark, "/root/testdata/sf0.001"))
    assert asked == [(["entity_id"], list(range(sizes[0], sizes[1] + 1)), 3)]
