"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents.

A window (``WINDOW`` consecutive item words) is a set of shingles (``SHINGLE`` words at a place in it). All of
them must be in a document that contains the window, so one of them is enough to look for: the rarest
by the number of times it occurs in the corpus. Steps:

1. one pass over the documents keeps the places of shingles that benchmark windows have;
2. their occurrences are counted over all documents, and each window's shingles ordered by rarity;
3. occurrences meet the windows' necessary shingle in an equality join;
4. the shingle's place in the window bounds where the window can begin and end in the document;
5. what is left is compared word by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stored, text_of

WINDOW, SHINGLE = 10, 5
# The filter of step 1 has some sixteen bits for each benchmark shingle, and this many at the most.
LEAST_BITS, MOST_BITS = 20, 26

# Bytes of words as they are, A-Z lowered, every other ASCII byte a space.
_PLAIN = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """The words of a whole text in UTF-8: runs of ASCII letters (lowered), digits and anything
    outside ASCII."""
    return text.encode().translate(_PLAIN).split()


def shingle_keys(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit key of each ``size`` consecutive words; none if there are fewer words."""
    if len(words) < size:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    keys = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        keys = (keys ^ codes[i : i + n]) * _STEP
        keys ^= keys >> np.uint64(29)
    return keys


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(win, words, k, size, key, n) of every shingle of every different window, and (win, item)
    naming the items that have a window.

    ``win`` is a hash of the window's words, ``k`` the shingle's place in it, ``n`` the window's
    length. An item of fewer words than a window is one window; its shingles are no longer than it.
    A null item_id is written as an empty text; items without words have no window.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], batch["text"]):
                words = words_of(text)
                n = min(window, len(words))
                for at in range(len(words) - n + 1 if words else 0):
                    out.append((item, b" ".join(words[at : at + n]).decode(), n))
            yield pd.DataFrame(out, columns=["item", "words", "n"]).astype({"item": "string", "words": "string", "n": "int32"})

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_of().alias("text"))
    named = stored(
        rows.mapInPandas(cut, "item string, words string, n int").distinct().withColumn("win", F.sha2("words", 256)), "windows"
    )

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for win, text, n in zip(batch["win"], batch["words"], batch["n"]):
                words = text.encode().split(b" ")
                size = min(shingle, len(words))
                out += [(win, text, k, size, int(key), n) for k, key in enumerate(shingle_keys(words, size).view(np.int64))]
            columns = {"win": "string", "words": "string", "k": "int32", "size": "int32", "key": "int64", "n": "int32"}
            yield pd.DataFrame(out, columns=list(columns)).astype(columns)

    once = named.select("win", "words", "n").distinct()
    parts = once.mapInPandas(shingles, "win string, words string, k int, size int, key long, n int")
    return stored(parts, "window_shingles"), named.select("win", "item")


def key_filter(parts: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """Marks of the keys in 2**bits bits, ``bits``, and the shingle sizes in use.

    Keys are met as marks in words of 64 bits, or-ed in Spark; at most 2**(MOST_BITS - 6) such words
    reach the driver. Other keys may hit a mark; the join afterwards is exact.
    """
    n = parts.select("key").distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - bits)
    marks = (
        parts.select(F.shiftrightunsigned(slot, 6).alias("slot"), slot.alias("all"))
        .groupBy("slot")
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(all & 63 as int))")).alias("mark"))
        .toPandas()
    )
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    table[marks["slot"].to_numpy(np.int64)] = marks["mark"].to_numpy(np.int64)
    sizes = sorted(r[0] for r in parts.select("size").distinct().collect())
    return table.view(np.uint64), bits, sizes


def occurrences(docs: DataFrame, parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """One stored row per document: row, doc_id, n_words and ``found``, an array of (size, at, key, first,
    around) for shingles that pass the filter of benchmark keys.

    ``around`` are the words, from number ``first``, that any window with this shingle can reach, so windows
    are compared word by word where they are found and no text is shuffled.
    """
    table, bits, sizes = key_filter(parts)
    schema = "doc_id long, n_words long, found array<struct<size:int,at:long,key:long,first:long,around:string>>"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        down, low = np.uint64(64 - bits), np.uint64(63)
        for batch in batches:
            counts, finds = [], []
            for text in batch["text"]:
                words = words_of(text)
                found = []
                for size in sizes:
                    keys = shingle_keys(words, size)
                    slots = keys >> down
                    hit = np.flatnonzero(table[slots >> np.uint64(6)] >> (slots & low) & np.uint64(1))
                    for at, key in zip(hit.tolist(), keys[hit].view(np.int64).tolist()):
                        first = max(0, at + size - window)
                        found.append({"size": size, "at": at, "key": key, "first": first, "around": b" ".join(words[first : at + window]).decode()})
                counts.append(len(words))
                finds.append(found)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_words": np.array(counts, dtype=np.int64), "found": finds})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(scan, schema)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "occurrences")


def contained_windows(scanned: DataFrame, parts: DataFrame) -> DataFrame:
    """(row, start, n, win) of every occurrence of a window in a document.

    Every window's necessary shingle is the rarest of its shingles in all documents (ties: the first);
    a window one of whose shingles never occurs cannot occur. Counting combines in the tasks
    first, so a passage that a third of the documents share costs a row per task and shingle.
    """
    places = (
        scanned.filter("size(found) > 0").select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    )
    counts = places.groupBy("size", "key").agg(F.count("*").alias("times"))
    ordered = parts.join(counts, ["size", "key"], "left").groupBy("win", "words", "n").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "k", "size", "key")).alias("rarest")
    )
    prefix = stored(
        ordered.filter("rarest.times > 0").select("win", F.col("words").alias("wanted"), "n", "rarest.k", "rarest.size", "rarest.key"), "prefix"
    )
    own = F.slice(F.split("around", " "), (F.col("start") - F.col("first") + 1).cast("int"), F.col("n"))
    return (
        places.join(prefix, ["size", "key"])
        .withColumn("start", F.col("at") - F.col("k"))
        # The whole window must lie within the document.
        .filter("start >= 0 and start + n <= n_words")
        .filter(F.array_join(own, " ") == F.col("wanted"))
        .select("row", "start", "n", "win")
    )


def words_covered(spans: Column) -> Column:
    """How many words an array of (start, n), sorted, covers; spans may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    end = lambda x: x["start"] + x["n"]
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], end(x)).alias("end"),
        (acc["total"] + F.greatest(F.lit(0).cast("long"), end(x) - F.greatest(acc["end"], x["start"]))).alias("total"),
    )
    return F.aggregate(spans, zero, step, lambda acc: acc["total"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated), one row per document row.

    ``n_hit`` counts the document's words inside any occurrence of any item's window, ``items`` are
    the sorted item_ids, as text, that have an occurring window; equal item_ids are one item. A null
    text has no words. Texts or items without words are not contaminated and contaminate nothing.
    Repeated rows are answered alike; no documents give no rows, no items leave all clean.
    """
    parts, named = item_windows(items, window, shingle)
    scanned = occurrences(docs, parts, window)
    found = stored(contained_windows(scanned, parts), "contained")
    hits = found.groupBy("row").agg(words_covered(F.array_sort(F.collect_set(F.struct("start", "n")))).alias("n_hit"))
    owners = (
        found.select("row", "win").distinct().join(named, "win").select("row", "item").distinct()
        .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    none = F.array().cast("array<string>")
    return (
        scanned.select("row", "doc_id", "n_words").join(hits.join(owners, "row"), "row", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )
