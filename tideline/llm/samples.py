"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stored, text_of

MAX_TRAIN = 20_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column | None = None, max_train: int = MAX_TRAIN
) -> DataFrame:
    """(text, y, part) of at most ``max_train`` labelled documents, stored; part is 0 to 9.

    ``allowed`` is a condition on doc_id. A document with several labels has the largest one;
    null ids and labels are left out. Copies of a text, which would count twice, are one row with
    the largest label among them and the smallest doc_id.
    The sample is chosen by a hash of the id at a rate that fits the number of labels, so the
    labels' side of the join has that many rows at most and is broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna()
    if allowed is not None:
        known = known.filter(allowed)
    known = known.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    rate = min(1.0, 0.9 * max_train / max(1, known.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(rate * (1 << 30))
    # The rate leaves a tenth to spare; should more be drawn, those with the smallest hashes count.
    chosen = known.filter(drawn).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10)).cast("int")
    return stored(sample.select("text", "y", part.alias("part")).repartition(16), "sample")
