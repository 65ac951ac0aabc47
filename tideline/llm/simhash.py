"""SimHash near duplicates: one-wildcard segment variants, equality join, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import stored, text_of
from tideline.llm.components import connected

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BUCKET = 16
_AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 majority bits of the text's shingle hashes as an unsigned number; 0 without words.

    Bytes lower and split as ASCII, which is what ``A-Z`` and the word pattern mean.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [tuple(words)]
    else:
        shingles = zip(*(words[i:] for i in range(shingle)))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        bits = np.unpackbits(hashes[at : at + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) per row; fp is the fingerprint's 64 bits as a signed long."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch.drop(columns="text").assign(fp=fps.view(np.int64))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text_of().alias("text"))
    return rows.mapInPandas(work, "doc_id long, text_hash long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(slot, bits, fp): each half of a fingerprint with each one bit taken out.

    Two fingerprints at most two bits apart differ by at most one bit in one half, so they share
    a variant of it. ``slot`` is 32 * half + the bit that is out.
    """
    half = F.expr("shiftrightunsigned(fp, 32 * (slot div 32)) & 4294967295L")
    return (
        fps.select("fp", F.explode(F.array(*(F.lit(i) for i in range(64)))).alias("slot"))
        .withColumn("half", half)
        .select("slot", F.expr("half & ~shiftleft(1L, slot % 32)").alias("bits"), "fp")
    )


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between different fingerprints at most two bits apart.

    Buckets of up to ``bucket`` fingerprints compare all their pairs. For larger ones the
    fingerprints are tied through the 65 values within one bit of each: two of them share such a
    value exactly if they are at most two bits apart, and a value has at most 65 fingerprints,
    which are tied to their smallest. This loses no link in the sense of components, gives no
    false one, and never emits the pairs of a large group.
    """
    of_bucket = Window.partitionBy("slot", "bits")
    members = variants(fps).withColumn("n", F.count("*").over(of_bucket)).filter("n > 1")
    members = stored(members, "variants")

    arrays = members.filter(F.col("n") <= bucket).groupBy("slot", "bits").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = (
        arrays.select("slot", "fps", F.posexplode("fps").alias("i", "a"))
        .filter(F.col("i") + 1 < F.size("fps"))
        .select("slot", "a", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("b"))
        .withColumn("d", F.expr("a ^ b"))
        .filter(f"bit_count(d) <= {MAX_BITS}")
        .withColumn("h", F.expr("shiftrightunsigned(d, 32 * (slot div 32)) & 4294967295L"))
        # Equal halves meet in 32 buckets; one of them counts.
        .filter("h = 0 and slot % 32 = 0 or h = shiftleft(1L, slot % 32)")
        .select("a", "b")
    )
    crowded = members.filter(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long") for i in range(64)))
    around = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.expr("fp ^ flip").alias("near"))
    ties = (
        around.withColumn("a", F.min("fp").over(Window.partitionBy("near")))
        .filter("a <> fp")
        .select("a", F.col("fp").alias("b"))
    )
    return pairs.union(ties).distinct()


def classified(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per row; root is the smallest fingerprint."""
    if max_bits != MAX_BITS:
        raise ValueError("halves with one wildcard serve a distance of 2 bits")
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected(links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document row.

    Fingerprints link at ``max_bits`` or fewer differing bits (2: the bound this index is cut
    for). component_id is the smallest doc_id that links reach, null where no document of the
    component has an id. Null and wordless texts have fingerprint zero and link like any other.
    Rows with equal fingerprints are one node however many they are. No rows: none.
    """
    return classified(docs, shingle, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id.

    A row is known by (doc_id, text): equal rows count once, but a doc_id that stands for texts of
    several groups stays once for each of them. Of several texts of that id in one group the one with the
    smallest hash stays. Where no row of a group has an id, one of them stays. Columns of any name
    pass through.
    """
    found = classified(docs.select("doc_id", "text"), shingle, max_bits)
    first = found.filter("doc_id <=> component_id").groupBy("root").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("kept")
    )
    keep = stored(first.select("kept.doc_id", "kept.text_hash").distinct(), "kept")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit(1), F.col("text")).alias("text_check"),
    )
    own = (whole["doc_id"].eqNullSafe(keep["doc_id"])) & (whole["text_hash"] == keep["text_hash"])
    rows = whole.join(keep, own, "left_semi")
    return rows.dropDuplicates(["doc_id", "text_hash", "text_check"]).select("row.*")
