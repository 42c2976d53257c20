"""Token-id files: raw payloads with a minimal perfect hash index from document keys to offsets.

A store is a folder of Parquet files, so any file system that Spark writes to can hold it and a lost executor
leaves no half-written part. Each row is a shard of consecutive documents in ascending key order:

========== ============================================================================================
part, block place of the shard: shards are in ascending key order by (part, block)
first_key, last_key  smallest and largest key (null: no document has one)
n_docs, n_ids        documents and ids in the shard
n_null     documents without a key, which come first
keys       keys in ascending order, little-endian signed 64-bit
payload    ids of all documents, little-endian unsigned 32-bit
offsets    little-endian unsigned 64-bit: first id of each document, and the end
bits       words of the hash's bit levels, little-endian unsigned 64-bit
levels     bits of each level
prints     per slot: 32-bit fingerprint of the key
slots      per slot: unsigned 32-bit number of the key's first document
========== ============================================================================================
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.llm.common import mix, shared_path
from wattloom.llm.tokens import piece_ids

SCHEMA = (
    "part int, block int, first_key long, last_key long, n_docs long, n_ids long, n_null long, keys binary, payload binary, offsets binary, "
    "bits binary, levels array<long>, prints binary, slots binary"
)
_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()),
    ("n_ids", pa.int64()), ("n_null", pa.int64()), ("keys", pa.binary()), ("payload", pa.binary()), ("offsets", pa.binary()), ("bits", pa.binary()),
    ("levels", pa.list_(pa.int64())), ("prints", pa.binary()), ("slots", pa.binary()),
])


def _place(keys: np.ndarray, level: int, width: int) -> np.ndarray:
    return (mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(width)).astype(np.int64)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Minimal perfect hash: a key's slot is the rank of its bit, in the first level where it fell alone."""

    def __init__(self, bits: np.ndarray, levels: list[int]):
        self.bits, self.levels = bits, levels
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """From distinct unsigned 64-bit keys."""
        words, levels = [], []
        while len(keys):
            width = -(-max(64, len(keys) * 3 // 2) // 64) * 64
            at = _place(keys, len(levels), width)
            alone = np.bincount(at, minlength=width) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            levels.append(width)
            keys = keys[~alone[at]]
        return cls(np.concatenate(words) if words else np.empty(0, dtype="<u8"), levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for one that was surely not built in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, base = np.arange(len(keys)), 0
        for level, width in enumerate(self.levels):
            at = base + _place(keys[left], level, width)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            left, base = left[~hit], base + width
            if not len(left):
                break
        return out


def _shard(part: int, block: int, keys: list, ids: list[bytes]) -> tuple:
    n_null = sum(k is None for k in keys)
    known = np.array(keys[n_null:], dtype=np.int64)
    distinct, first = np.unique(known, return_index=True)
    distinct = distinct.astype(np.uint64)
    index = PerfectHash.build(distinct)
    slot = index.slots(distinct)
    prints, slots = np.empty(len(distinct), dtype="<u4"), np.empty(len(distinct), dtype="<u4")
    prints[slot], slots[slot] = _prints(distinct), first + n_null
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("<u8")
    smallest, largest = (int(known[0]), int(known[-1])) if len(known) else (None, None)
    return (
        part, block, smallest, largest, len(keys), int(ends[-1]), n_null, known.astype("<i8").tobytes(), b"".join(ids), ends.tobytes(),
        index.bits.astype("<u8").tobytes(), index.levels, prints.tobytes(), slots.tobytes(),
    )


class Shard:
    """One row of a store; ``get(keys)`` is keyed access in constant time a key."""

    def __init__(self, row: dict):
        self.payload, self.n_null = row["payload"], row["n_null"]
        self.offsets = np.frombuffer(row["offsets"], dtype="<u8").astype(np.int64)
        self.index = PerfectHash(np.frombuffer(row["bits"], dtype="<u8"), list(row["levels"]))
        self.prints, self.first = np.frombuffer(row["prints"], dtype="<u4"), np.frombuffer(row["slots"], dtype="<u4")

    def documents(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key's first document in the shard, -1 where the fingerprint differs."""
        keys = keys.astype(np.uint64)
        slot = self.index.slots(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        if len(self.prints):
            good = (slot >= 0) & (self.prints[np.maximum(slot, 0)] == _prints(keys))
            out[good] = self.first[slot[good]]
        return out

    def ids(self, document: int) -> memoryview:
        return memoryview(self.payload)[4 * self.offsets[document] : 4 * self.offsets[document + 1]]


def write_ids(
    docs: DataFrame, vocabulary: str, end_id: int, path: str, doc_id: str = "doc_id", text: str = "text", shard_ids: int = 1_000_000
) -> None:
    """Encode every row's whole text, append ``end_id``, and write a store at ``path`` in ascending key order.

    Keys are integers. A null text is an empty one; rows without a key come first; rows with equal keys follow
    each other in the order of their texts' hashes, and may span shards, so no key's rows meet in one task.
    An empty table gives an empty store. One shuffle, by ranges of the key; a task holds one shard.
    """

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, end = piece_ids(vocabulary).each, end_id.to_bytes(4, "little")
        part, block, keys, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            values = _shard(part, block, keys, ids)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _ARROW.types)], schema=_ARROW)

        for batch in rows:
            for key, found in zip(batch.column(0).to_pylist(), each(batch.column(1).to_pylist())):
                keys.append(key)
                ids.append(found + end)
                size += len(ids[-1]) // 4
                if size >= shard_ids:
                    yield row()
                    block, keys, ids, size = block + 1, [], [], 0
        if keys:
            yield row()

    rows = docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    placed = rows.repartitionByRange("key", tie).sortWithinPartitions("key", tie)
    placed.mapInArrow(encode, SCHEMA).write.option("compression", "zstd").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def lookup(spark: SparkSession, path: str, keys: list[int]) -> dict[int, list[list[int]]]:
    """Ids of each key's documents, for a short list of keys; keys that are not there are left out.

    Shards are found by the key range in their column statistics, documents by the hash.
    """
    fits = F.lit(False)
    for key in keys:
        fits |= (F.col("first_key") <= key) & (F.col("last_key") >= key)
    out: dict[int, list[list[int]]] = {}
    for row in open_store(spark, path).where(fits).orderBy("part", "block").toLocalIterator():
        shard, inside = Shard(row.asDict()), np.array([k for k in keys if row.first_key <= k <= row.last_key], dtype=np.int64)
        for key, at in zip(inside.tolist(), shard.documents(inside).tolist()):
            if at < 0:
                continue
            following = shard.first[shard.first > at]
            for d in range(at, int(following.min()) if len(following) else row.n_docs):
                out.setdefault(key, []).append(np.frombuffer(shard.ids(d), dtype="<u4").tolist())
    return out


def read_ids(store: DataFrame) -> DataFrame:
    """part, block, doc_id, first (ids of the shard's documents before it), n_tokens and ids (binary) of every document.

    Each shard's stored keys go through its hash, and the fingerprints must agree.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                shard = Shard(row)
                keys = np.unique(np.frombuffer(row["keys"], dtype="<i8"))
                at = shard.documents(keys)
                if (at < 0).any():
                    raise ValueError(f"shard {row['part']}/{row['block']}: a key is not in its index")
                runs = np.diff(np.append(at, row["n_docs"]))
                documents = [*range(shard.n_null), *(d for a, n in zip(at.tolist(), runs.tolist()) for d in range(a, a + n))]
                names = [None] * shard.n_null + np.repeat(keys, runs).tolist()
                for i in range(0, len(documents), 500):
                    ids = [bytes(shard.ids(d)) for d in documents[i : i + 500]]
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(names[i : i + n], pa.int64()),
                            pa.array(shard.offsets[documents[i : i + n]], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                        ],
                        names=["part", "block", "doc_id", "first", "n_tokens", "ids"],
                    )

    return store.mapInArrow(run, "part int, block int, doc_id long, first long, n_tokens long, ids binary")


def global_starts(rows: DataFrame, store: DataFrame) -> DataFrame:
    """``rows`` of :func:`read_ids` with start (ids of all documents before) in place of part, block and first.

    The totals of shards are summed by part and carried over the parts, then over a part's blocks.
    """
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row a part is all that one task sees
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("block")
    starts = store.select("part", "block", "n_ids").join(parts, "part")
    starts = starts.select("part", "block", (F.col("before") + F.sum("n_ids").over(inside) - F.col("n_ids")).alias("before"))
    return rows.join(starts, ["part", "block"]).withColumn("start", F.col("before") + F.col("first")).drop("part", "block", "before", "first")


def new_store(spark: SparkSession) -> str:
    return shared_path(spark, "ids")
