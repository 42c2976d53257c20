"""Pieces of text, and their ids when many are encoded at once."""

import time

import numpy as np
import pytest

pytest.importorskip("tokenizers")

from wattloom.llm import tokens  # noqa: E402

TEXTS = [
    "", " ", "a", " a b", "a  b ", "a \n b\tc", "x\0 y \0z", "Foo foo FOO's 12 don't <|endoftext|> in <|endoftext|>side <|startoftext|>x y",
    "naïve été 　wide  no break", "line one\nline two   three", "日本 語 \U0001f600\U0001f600 ok", "trail ",
]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_are_cut_before_a_space_and_a_character(text):
    assert tokens.pieces(text) == tokens.CUT.split(text)


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_pieces_together_are_those_of_the_whole_text(vocabulary):
    encode = tokens.tokenizer(vocabulary).encode
    texts = [*TEXTS, " ".join(TEXTS), " ".join(f"w{i}x <|endoftext|>{i}" for i in range(50))]
    whole = [np.array(encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert tokens.PieceIds(vocabulary).of(texts) == whole


def test_plain_texts_are_cut_faster():
    text = "some words of text " * 20_000 + "end"

    def took(f):
        times = []
        for _ in range(5):
            start = time.perf_counter()
            f(text)
            times.append(time.perf_counter() - start)
        return min(times)

    assert took(tokens.pieces) < 0.7 * took(tokens.CUT.split)
