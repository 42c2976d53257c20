"""Benchmark decontamination by winnowing, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    # split at what is between words: regexp_extract_all took about ten times as long
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def _gram(hashes: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(hashes, i + j) for j in range(k)))


def _hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _context(ws: Column, h: Column, p: Column, k: int, reach: int) -> Column:
    """Fingerprint at word p (from 0): its hash, place, words, and up to ``reach`` words before and after."""
    before = F.slice(ws, F.greatest(p - reach, F.lit(0)) + 1, F.least(p, F.lit(reach)))
    return F.struct(h.alias("h"), p.alias("pos"), F.slice(ws, p + 1, F.lit(k)).alias("gram"), F.reverse(before).alias("left"), F.slice(ws, p + k + 1, F.lit(reach)).alias("right"))


def fingerprints(ws: Column, k: int, window: int) -> Column:
    """Per window of ``window`` words, the k-gram with the smallest hash (the first of equal ones), once each."""
    reach, per = window - k, window - k + 1

    def chosen(grams: Column) -> Column:
        def smallest(j: Column) -> Column:
            return _let(F.slice(grams, j + 1, F.lit(per)), lambda s: (j + F.array_position(s, F.array_min(s)) - 1).cast("int"))

        places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(ws) - window), smallest))
        return F.transform(places, lambda p: _context(ws, F.get(grams, p), p, k, reach))

    def grams(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: _gram(hashes, i, k))

    return F.when(F.size(ws) >= window, _let(_let(_hashes(ws), grams), chosen))


def _all_grams(ws: Column, k: int) -> Column:
    def grams(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda p: _context(ws, _gram(hashes, p, k), p, k, 0))

    return F.when(F.size(ws) >= k, _let(_hashes(ws), grams))


def _agree(a: str, b: str) -> Column:
    """How many words two contexts share, counted from the fingerprint outwards."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return _let(same, lambda s: F.when(F.array_contains(s, False), F.array_position(s, False).cast("int") - 1).otherwise(F.size(s)))


def _hits(docs: DataFrame, items: DataFrame, small: bool, k: int, window: int) -> DataFrame:
    """doc_id, alone, item_id, lo, hi: spans of document words inside occurrences of item windows."""
    # not inline(): it would have Spark test "prints" for being empty below, with the words found anew for every use
    items = items.select("item_id", F.inline_outer("prints")).select("h", "item_id", *(F.col(c).alias(f"i_{c}") for c in ("gram", "left", "right")))
    found = docs.select("doc_id", "alone", F.inline_outer("prints")).join(F.broadcast(items) if small else items, "h")
    found = found.where(F.col("gram") == F.col("i_gram")).withColumns({"_l": _agree("left", "i_left"), "_r": _agree("right", "i_right")})
    found = found.where(F.col("_l") + F.col("_r") + k >= window)
    return found.select("doc_id", "alone", "item_id", (F.col("pos") - F.col("_l")).alias("lo"), (F.col("pos") + k + F.col("_r") - 1).alias("hi"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, n_words, hit (numbers of the words inside occurrences of item windows, from 0) and items of every row.

    A window is ``window`` consecutive words of an item, or all of a shorter item that has any. Of every window
    both sides keep the k-gram with the smallest hash, so a shared window has a shared fingerprint at the same
    place in it; a hit is extended word by word up to the window's reach on either side, and counts if it spans
    a window. Hits are found by a join on the hash: items of at most ``broadcast_bytes`` of text are
    broadcast, larger benchmarks are shuffled. Shorter items are compared as whole grams of their length.

    A null or empty text has no words and no hits; null and empty items have no windows. An item's id counts
    once, however often its row is repeated, and an item without an id is hit without being listed. Rows of
    ``docs`` are all kept; rows with the same doc_id are taken as one document's, and share their
    hits; a row without one is judged alone, by its text. Empty tables on either side give no hits. Other columns are not carried.
    """
    alone = F.when(F.col(doc_id).isNull(), F.sha2(F.col(text), 256)).alias("alone")
    docs = docs.select(F.col(doc_id).alias("doc_id"), alone, words(F.col(text)).alias("ws"))
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("ws"), F.octet_length(item_text).alias("_b"))
    about = items.agg(F.sum("_b").alias("size"), F.collect_set(F.when(F.size("ws").between(1, window - 1), F.size("ws"))).alias("short")).first()
    small = (about["size"] or 0) <= broadcast_bytes
    prints = [(fingerprints(F.col("ws"), k, window), F.lit(True), k, window)]
    prints += [(_all_grams(F.col("ws"), n), F.size("ws") == n, n, n) for n in sorted(about["short"])]
    found = reduce(
        DataFrame.unionByName,
        (
            _hits(docs.select("doc_id", "alone", p.alias("prints")), items.where(which).select("item_id", p.alias("prints")), small, size, span)
            for p, which, size, span in prints
        ),
    )
    found = found.groupBy("doc_id", "alone").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("lo", "hi"))))).alias("hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    rows = docs.select("doc_id", "alone", F.size("ws").cast("long").alias("n_words"))
    none = F.array()
    found = found.withColumnsRenamed({"doc_id": "_d", "alone": "_a"})
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("alone").eqNullSafe(F.col("_a")), "left").select(
        "doc_id", "n_words", F.coalesce("hit", none.cast("array<int>")).alias("hit"), F.coalesce("items", none.cast("array<string>")).alias("items")
    )
