"""What a worker keeps of packing is bounded by the caller."""

import pytest

pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from wattloom.llm import packing, tokens  # noqa: E402


def test_packing_keeps_few_pieces_of_text(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(packing, "pack", lambda *a, **k: asked.update(k))
    corpus_pipeline.pack_sequences(spark, None, "")
    assert asked["cache"] <= 200_000
    ids = tokens.piece_ids("byte_bpe_50k.json", 50)
    whole = tokens.PieceIds("byte_bpe_50k.json")
    texts = [" ".join(f"w{i * j}" for j in range(20)) for i in range(30)]
    assert list(ids.each(texts, chars=60)) == list(whole.each(texts))
    assert len(ids.known) < 100 < len(whole.known)


def test_packing_with_a_small_cache_gives_the_same_pieces(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j}" for j in range(i))) for i in range(60)] + [(None, None)], "doc_id long, text string").coalesce(1)
    rows = [sorted(map(str, packing.pack(docs, "byte_bpe_50k.json", 0, capacity=32, cache=c).collect())) for c in (10, 2_000_000)]
    assert rows[0] == rows[1]
