"""A text classifier trained in the library: multinomial naive Bayes from two aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import tokens
from tideline.session import staged


def term_counts(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, term, n) of every different word of every row's text, counted within the row: no shuffle.

    The words are sorted; a word's last place less that of the word before it is its count.
    """
    words = docs.select(F.col(row_id), F.sort_array(tokens(text)).alias("__words")).filter(F.size("__words") > 0)
    last = F.filter(F.sequence(F.lit(1), F.size("__words")), lambda i: ~F.get("__words", i).eqNullSafe(F.get("__words", i - 1)))
    words = words.withColumn("__last", last)
    counted = F.transform(
        "__last", lambda i, at: F.struct(F.get("__words", i - 1).alias("term"), (i - F.coalesce(F.get("__last", at - 1), F.lit(0))).alias("n"))
    )
    return words.select(row_id, F.inline(counted))


def fit(labelled: DataFrame, text: str, label: str, smoothing: float = 1.0) -> DataFrame:
    """(term, weight, prior): how much a word speaks for label 1 against label 0, in logarithms.

    Words are counted per label (a frequent word costs a row per task), smoothed by
    ``smoothing``. ``prior`` is the logarithm of the labels' odds, the same in all rows. Null labels take
    no part. Without documents of both labels nothing can be told apart: no rows.
    """
    known = labelled.filter(F.col(label).isin(0, 1))
    one = F.col(label) == 1
    words = known.select(one.alias("one"), F.explode(tokens(text)).alias("term"))
    counts = staged(words.groupBy("term").agg(F.count_if("one").alias("n1"), F.count_if(~F.col("one")).alias("n0")), "terms")
    total = counts.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count("*").alias("kinds")).first()
    docs = known.agg(F.count_if(one).alias("n1"), F.count_if(~one).alias("n0")).first()
    if not docs["n1"] or not docs["n0"]:
        return counts.select("term", F.lit(0.0).alias("weight"), F.lit(0.0).alias("prior")).limit(0)

    def share(n: str) -> Column:
        return F.log((F.col(n) + smoothing) / F.lit((total[n] or 0) + smoothing * total["kinds"]))

    return counts.select("term", (share("n1") - share("n0")).alias("weight"), F.lit(math.log(docs["n1"] / docs["n0"])).alias("prior"))


def score(docs: DataFrame, model: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, score, label) of every text: the logarithm of the odds of label 1, and 1 if it is above 0.

    Words the model does not know say nothing; a text without known words has the prior's score, and
    0 if the model is empty. Rows of one id are one document. The model meets the words in a join, hashed
    rather than sorted, so that only the words' one shuffle is written.
    """
    prior = model.agg(F.max("prior")).first()[0] or 0.0
    found = term_counts(docs, row_id, text).join(model.select("term", "weight").hint("shuffle_hash"), "term")
    sums = found.groupBy(row_id).agg(F.sum(F.col("n") * F.col("weight")).alias("__sum"))
    ids = docs.select(row_id).distinct().withColumnRenamed(row_id, "__id")
    rows = ids.join(sums, ids["__id"].eqNullSafe(sums[row_id]), "left")
    total = F.coalesce("__sum", F.lit(0.0)) + F.lit(prior)
    return rows.select(F.col("__id").alias(row_id), total.alias("score"), (total > 0).cast("int").alias("label"))
