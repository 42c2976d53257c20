"""Components of near-duplicates take few jobs, and mixed nodes and branches are made once."""

import random

import pytest

from wattloom.llm import neardup


def _naive(links):
    parent = {x: x for pair in links for x in pair}
    for _ in parent:
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    return {x: p for x, p in parent.items() if x != p}


@pytest.mark.parametrize("piece", [7, 200_000])
def test_components_in_pieces_are_those_of_all_links(spark, monkeypatch, piece):
    monkeypatch.setattr(neardup, "PIECE", piece)
    rng = random.Random(piece)
    links = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, i) for i in range(501, 540)] + [(9, 9), (3, 2)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = [(r.doc, r.component) for r in neardup.components(df).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == _naive(links)
    assert neardup.components(df.where("a < 0")).count() == 0


def test_components_of_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    spark.sparkContext.setJobGroup("few_links", "components")
    try:
        assert neardup.components(links).count() == 200
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few_links")) <= 12
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_mixed_nodes_and_branches_are_made_once(spark, monkeypatch):
    made, mixed, branches, written = [], neardup._mixed, neardup._branches, neardup.written
    monkeypatch.setattr(neardup, "_mixed", lambda *a: made.append(mixed(*a)) or made[-1])
    monkeypatch.setattr(neardup, "_branches", lambda *a: made.append(branches(*a)) or made[-1])
    kept = []
    monkeypatch.setattr(neardup, "written", lambda df, name: kept.append(df) or written(df, name))
    monkeypatch.setattr(neardup, "branched", lambda *a, f=neardup.branched: f(*a, small=3))
    base = " ".join(f"w{i}" for i in range(40))
    # sets that share half of their shingles meet in nodes, and are not linked
    texts = [(i, f"{base} " + " ".join(f"u{i}x{j}" for j in range(30))) for i in range(40)]
    assert neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).where("kept").count() == 40
    assert len(made) > 1 and all(any(df is x for x in kept) for df in made)
