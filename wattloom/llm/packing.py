"""Packing by minimum bin slack over the lengths that remain."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.tokens import piece_ids


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset {length: times} with the largest sum up to ``capacity``, the largest length included.

    ``counts`` has how often each length, from 1 to capacity, is there. Bit s of ``reach`` says that some
    multiset sums up to s; multiplicities are tried in powers of two, and the bitsets before each step lead
    back to the counts.
    """
    lengths = sorted(counts, reverse=True)
    first, room = lengths[0], capacity - lengths[0]
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        left = min(counts[length] - (length == first), room // length) if length <= room else 0
        times = 1
        while left > 0:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, times = left - take, times * 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


class _Bins:
    """Remainders by length, as stacks of (document, start, ids); ids in bytes of four."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.n = capacity, defaultdict(list), 0

    def add(self, doc: tuple, start: int, ids: bytes) -> None:
        self.items[len(ids) // 4].append((doc, start, ids))
        self.n += 1

    def pop(self, length: int) -> tuple:
        stack = self.items[length]
        item = stack.pop()
        if not stack:
            del self.items[length]
        self.n -= 1
        return item

    def sequences(self, last: bool) -> Iterator[list[tuple]]:
        """Full sequences; if ``last``, all that is left, with cuts that fill every sequence but one."""
        while self.items:
            used = fullest({k: len(v) for k, v in self.items.items()}, self.capacity)
            slack = self.capacity - sum(k * v for k, v in used.items())
            if slack and not last:
                return
            for _ in range(1 if slack else min(len(self.items[k]) // v for k, v in used.items())):
                sequence = [self.pop(k) for k, v in used.items() for _ in range(v)]
                if slack and self.items:
                    # whatever is left is longer than the slack, or it would have been taken
                    doc, start, ids = self.pop(max(self.items))
                    sequence.append((doc, start, ids[: 4 * slack]))
                    self.add(doc, start + slack, ids[4 * slack :])
                yield sequence


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    capacity: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
    block_tokens: int = 4_000_000,
    cache: int = 2_000_000,
) -> DataFrame:
    """All documents as pieces of sequences of at most ``capacity`` ids, with almost no padding.

    Each document's ids end with ``end_id``. Long documents give whole sequences; the remainders of a task's
    documents are combined by minimum bin slack, a block at a time, and what fills no sequence waits for the
    next block. Only at the end of a task are remainders cut to fill up, so only one sequence of a task can
    need padding. Nothing is shuffled; a task holds one block, the waiting remainders, some documents and the ids of
    up to ``cache`` pieces of text (about 150 bytes each, which its worker keeps).

    Returns doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset
    and padded_length (the sequence's total if a power of two, else ``capacity``). A null text is an empty one,
    which is a piece of the end id alone. Repeated rows and rows without an id are documents of their own.
    An empty table gives no pieces. Sequence ids are unique, not dense.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = piece_ids(vocabulary, cache).each, end_id.to_bytes(4, "little")
        bins, number, whole, waiting = _Bins(capacity), TaskContext.get().partitionId() << 33, [], 0
        out: list[tuple] = []

        def emit(sequence: list[tuple]) -> None:
            nonlocal number
            total, at = sum(len(ids) for *_, ids in sequence) // 4, 0
            padded = total if total & (total - 1) == 0 else capacity
            for (key, n), start, ids in sequence:
                out.append((key, start, len(ids) // 4, ids, n, number, at, padded))
                at += len(ids) // 4
            number += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        schema = None
        for batch in (b.slice(i, 1000) for b in rows for i in range(0, len(b), 1000)):
            if schema is None:
                schema = pa.schema(
                    [("doc_id", batch.schema.types[0]), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_length", pa.int64())]
                )
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids += end
                doc, n = (key, len(ids) // 4), len(ids) // 4
                for start in range(0, n - capacity + 1, capacity):
                    emit([(doc, start, ids[4 * start : 4 * (start + capacity)])])
                if n % capacity:
                    bins.add(doc, n - n % capacity, ids[4 * (n - n % capacity) :])
                    waiting += n % capacity
                if len(out) >= 2_000:
                    yield flush()
                if waiting >= block_tokens:
                    for sequence in bins.sequences(False):
                        emit(sequence)
                        if len(out) >= 2_000:
                            yield flush()
                    waiting = 0
        for sequence in bins.sequences(True):
            emit(sequence)
            if len(out) >= 2_000:
                yield flush()
        if out:
            yield flush()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long"
    )
