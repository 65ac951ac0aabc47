"""Bursts: terms used far more on a day than their decayed past says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.insights import top_rows


def daily_counts(rows: DataFrame, day: Column, terms: Column) -> DataFrame:
    """(day, term, n) of an array of terms per row; null days and terms are left out."""
    used = rows.select(day.cast("date").alias("day"), F.explode(terms).alias("term"))
    return used.filter("day is not null and term is not null").groupBy("day", "term").agg(F.count(F.lit(1)).alias("n"))


def bursts(counts: DataFrame, k: int, decay: float = 0.8, horizon: int = 14, least_expected: float = 0.5) -> DataFrame:
    """The ``k`` terms of each day that exceed their expectation most.

    ``counts`` is (day, term, n), one row per day and term. A term's share of a day's uses is weighed by
    ``decay`` to the number of days passed since, over the ``horizon`` days before; days in which the term does not
    occur count as zero, days without any term not at all. The mean share times the day's uses
    is ``expected`` (``least_expected`` or more), and ``score`` the logarithm of how much likelier n is with a Poisson mean
    of n than of ``expected``. Days with nothing in the horizon have no result. Equal scores (to six
    places) rank by term.

    Windows are by term, with one row per day; the days' totals are one row per day.
    """
    dated = counts.withColumn("at", F.unix_date("day").cast("long"))
    totals = dated.groupBy("at").agg(F.sum("n").alias("total"))
    past = Window.orderBy("at").rangeBetween(-horizon, -1)
    weights = F.aggregate(F.collect_list("at").over(past), F.lit(0.0), lambda s, d: s + _weight(F.col("at") - d, decay))
    known = totals.withColumn("weights", weights)
    shares = dated.join(known, "at").withColumn("share", F.col("n") / F.col("total"))
    before = Window.partitionBy("term").orderBy("at").rangeBetween(-horizon, -1)
    seen = shares.withColumn("seen", F.collect_list(F.struct("at", "share")).over(before)).filter(F.col("weights") > 0)
    weighed = F.aggregate("seen", F.lit(0.0), lambda s, x: s + _weight(F.col("at") - x["at"], decay) * x["share"])
    expected = F.greatest(weighed / F.col("weights") * F.col("total"), F.lit(least_expected))
    scored = seen.select("day", "term", "n", expected.alias("expected")).filter("n > expected")
    score = F.col("n") * F.ln(F.col("n") / F.col("expected")) - (F.col("n") - F.col("expected"))
    scored = scored.withColumn("score", F.round(score, 6))
    return top_rows(scored, ["day"], [F.desc("score"), F.asc("term")], k)


def _weight(days: Column, decay: float) -> Column:
    return F.pow(F.lit(decay), (days - 1).cast("double"))


def sketches(rows: DataFrame, by: list[str], term: str, places: int = 4096) -> DataFrame:
    """One frequent-items sketch of at most ``places`` terms per group: what a micro-batch keeps of its terms.

    Sketches of batches, days or tasks combine; a hot group is summed up in the map tasks.
    """
    kept = rows.filter(F.col(term).isNotNull())
    return kept.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(`{term}`, {places})").alias("sketch"), F.count(F.lit(1)).alias("n"))


def top_of_sketches(parts: DataFrame, by: list[str], k: int, places: int = 4096) -> DataFrame:
    """(by, term, count, error): the ``k`` most used terms of the combined sketches.

    ``count`` differs from the true one by at most ``error``, 3.5 uses in ``places``, and is exact (error 0)
    while a group has few different terms (up to three quarters of ``places``).
    """
    whole = parts.groupBy(*by).agg(F.expr(f"approx_top_k_combine(sketch, {places})").alias("sketch"), F.sum("n").alias("n"))
    top = whole.select(*by, "n", F.explode(F.expr(f"approx_top_k_estimate(sketch, {k})")).alias("__t"))
    return top.select(*by, F.col("__t.item").alias("term"), F.col("__t.count").alias("count"), F.floor(F.col("n") * 3.5 / places).alias("error"))
