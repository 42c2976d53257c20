"""Anchors of many texts at once, and ranks of symbols."""

import numpy as np

from wattloom.llm import substrings
from wattloom.llm.common import utf8_words
from wattloom.llm.fmindex import WaveletMatrix


def test_anchors_do_not_depend_on_how_texts_are_taken(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["a", "bb", "Über", "日本", "x" * 200, "𝔸", "\ud800", "a b", "\x1f", "c"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\t", "\n \x0b", "\r\x0c"]) for _ in range(n)) for n in (0, 1, 4, 5, 6, 30, 200)] + [None, " \n"]
    found = []
    for chunk in (1 << 18, 300, 7):
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        found.append([a.tolist() for a in substrings._text_anchors(texts, 5)])
    assert found[0] == found[1] == found[2]
    assert [len(a) for a in found[0]] == [max(0, len(utf8_words(t)) - 4) for t in texts]
    # equal windows have equal anchors, wherever they are
    (alone,) = substrings._text_anchors([b" ".join(utf8_words(texts[6])[90:99]).decode("utf-8", "surrogatepass")], 5)
    assert alone.tolist() == found[0][6][90:95]


def test_ranks_count_symbols_before_a_place():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 11, 500)
    symbol, lo = rng.integers(0, 11, 80), rng.integers(0, 501, 80)
    hi = rng.integers(lo, 501)
    before, upto = WaveletMatrix(text, 11).ranks(symbol, lo, hi)
    assert before.tolist() == [int((text[:i] == s).sum()) for s, i in zip(symbol, lo)]
    assert upto.tolist() == [int((text[:i] == s).sum()) for s, i in zip(symbol, hi)]
