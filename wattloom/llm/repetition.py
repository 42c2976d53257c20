"""Quality rule on repetition, from suffix arrays over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import WORD

SYMBOLS = "#*$%&|<>"


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and longest common prefixes (with the suffix before) of an array of word numbers.

    Ranks of the first 1, 2, 4, ... words refine each other; only suffixes that still tie are sorted again.
    A common prefix is read off those ranks from the longest power down. A document's words must have
    numbers no other document has, so that no suffix is alike beyond its document's end.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.concatenate(([True], words[order][1:] != words[order][:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order], rank[n] = start, -1
    ranks, step = [rank], 1
    while step < n:
        tied = ~new | np.concatenate((~new[1:], [False]))
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        rows = order[slots]
        second = rank[np.minimum(rows + step, n)]
        by = np.lexsort((second, rank[rows]))
        rows, first, second = rows[by], rank[rows][by], second[by]
        order[slots] = rows
        new[slots] = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = rank.copy()
        rank[rows] = start[slots]
        ranks.append(rank)
        step *= 2
    lcp = np.zeros(n, dtype=np.int64)
    pair = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[pair - 1].copy(), order[pair].copy()
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][np.minimum(a, n)] == ranks[k][np.minimum(b, n)]
        same &= (a < n) & (b < n)
        gain = np.where(same, 1 << k, 0)
        lcp[pair] += gain
        a += gain
        b += gain
    return order, lcp


def repeat_lengths(words: np.ndarray) -> np.ndarray:
    """For each position the length of the longest repeated substring that starts there.

    That is the larger of the common prefixes with the neighbours in the suffix array. A substring of a
    common-prefix interval is maximal where the position before has no longer one; its span then
    [position, position + length).
    """
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    order, lcp = suffix_array(words)
    out = np.empty(len(words), dtype=np.int64)
    out[order] = np.maximum(lcp, np.concatenate((lcp[1:], [0])))
    return out


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeated substring of ``least`` words or more."""
    n = len(lengths)
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(lengths >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + lengths[at], -1)
    return np.cumsum(edge[:n]) > 0


def _block(texts: list[str | None], least: int) -> list[tuple]:
    numbers: dict = {}
    words = [WORD.findall(t) if t else [] for t in texts]
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), dtype=np.int64)
    sizes = np.array([len(ws) for ws in words], dtype=np.int64)
    doc = np.repeat(np.arange(len(words)), sizes)
    lengths = repeat_lengths(doc * (len(numbers) + 1) + flat)
    long, five = covered(lengths, least), covered(lengths, 5)
    ends = np.cumsum(sizes)
    out = []
    for t, ws, n, end in zip(texts, words, sizes.tolist(), ends.tolist()):
        mine = slice(end - n, end)
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], long[mine].astype(np.int8), [0]))))
        out.append((
            n, sum(map(len, ws)), sum(map((t or "").count, SYMBOLS)), len(lines) - len(set(lines)), int(five[mine].sum()),
            int(long[mine].sum()), int(lengths[mine].max(initial=0)), edges.tolist(),
        ))
    return out


def repetition(docs: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text", block_words: int = 200_000) -> DataFrame:
    """Counts of every row's whole text, and its repeated substrings of ``least`` words or more.

    Returns doc_id, n_words, word_chars (code points), n_symbols, n_dup_lines, n_repeat_words (words in
    5-word windows found twice or more), covered_words (words in the union of repeated substrings),
    longest_repeat (words) and edges (starts and ends of the union's spans, in words, in turn). A null or empty
    text has zeros and no span. Repeated rows and rows without an id are judged one by one; an empty table
    gives an empty result. Documents are sorted together in blocks of about ``block_words`` words, so a task
    holds one block, or one document where that is longer.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys, texts, i = batch.column(0), batch.column(1).to_pylist(), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < block_words):
                    size += len(texts[j] or "") // 6
                    j += 1
                columns = list(zip(*_block(texts[i:j], least)))
                arrays = [keys.slice(i, j - i), *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=NAMES)
                i = j

    NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "edges"]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in NAMES[1:-1]) + ", edges array<long>"
    )


def quality(docs: DataFrame, max_covered: float = 0.3, max_repeat: int = 100, least: int = 10, **columns: str) -> DataFrame:
    """:func:`repetition` with the base rule and the verdict.

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated 5-word windows. kept: not
    base_failed, at most ``max_covered`` of the words in repeated substrings of ``least`` words or more, and no
    repeated substring of more than ``max_repeat`` words.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    well = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return repetition(docs, least, **columns).withColumns({"base_failed": base, "kept": ~base & well})
