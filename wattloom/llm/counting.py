"""Token counts by a two-tier lookup: a broadcast table of frequent pre-tokens, then a worker cache."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.tokens import pieces, tokenizer

FREQUENT = 16_384
_TABLES: dict = {}


def _top(counts: Counter, n: int) -> Counter:
    return counts if len(counts) <= n else Counter(dict(counts.most_common(n)))


def frequent_pieces(docs: DataFrame, text: str = "text", n: int = FREQUENT) -> list[str]:
    """About the n most frequent pre-tokens of all texts, most frequent first.

    Each task counts its whole input in a table that is cut back to 4n entries when it reaches 16n, and sends
    its top n; the summaries are merged in a tree. Nothing is shuffled by pre-token, no task or driver holds
    more than a few summaries, and the list only decides what is fast, never what is counted.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in rows:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(p for p in pieces(t) if len(p) <= 32)
                    if len(counts) > 16 * n:
                        counts = _top(counts, 4 * n)
        yield pa.RecordBatch.from_pydict({"summary": [json.dumps(_top(counts, n))]})

    def merge(a: Counter, b: Counter) -> Counter:
        a.update(b)
        return _top(a, 2 * n)

    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, "summary string").rdd
    found = parts.map(lambda r: Counter(json.loads(r.summary))).treeAggregate(Counter(), merge, merge, depth=3)
    return [p for p, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:n]]


class _Frequent(dict):
    """The broadcast tier; what it lacks is looked up in, or encoded into, the worker's cache."""

    def __init__(self, table: dict, vocabulary: str, bound: int):
        super().__init__(table)
        self.cache: dict[str, int] = {}
        self.encode, self.bound = tokenizer(vocabulary).encode, bound

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = len(self.encode(piece, add_special_tokens=False).ids)
            if len(piece) <= 64:
                if len(self.cache) >= self.bound:
                    self.cache.clear()
                self.cache[piece] = n
        return n


def token_counts(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, cache: int = 1_000_000
) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens (as the tokenizers library counts, nothing added) of every row.

    A null text counts as an empty one: no bytes, no tokens. Rows are kept as they are, also repeated ones and
    those without an id; other columns are not carried. Texts of any length are counted whole. An empty table
    gives an empty result. The broadcast table holds at most ``frequent`` pieces of up to 32 characters (under
    4 MB), a worker's cache at most ``cache`` pieces of up to 64; longer pieces are encoded each time.
    """
    spark = docs.sparkSession
    known = frequent_pieces(docs, text, frequent)
    encode = tokenizer(vocabulary).encode
    at = uuid.uuid4().hex
    lengths = spark.sparkContext.broadcast({p: len(encode(p, add_special_tokens=False).ids) for p in known})

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _TABLES.get(at)
        if table is None:
            _TABLES.clear()
            table = _TABLES[at] = _Frequent(lengths.value, vocabulary, cache)
        lookup = table.__getitem__
        for batch in rows:
            counts = [sum(map(lookup, pieces(t))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    )
    return rows.mapInArrow(count, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, n_tokens long")
