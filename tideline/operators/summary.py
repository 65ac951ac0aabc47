"""Summary tables and trending terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import tokens
from tideline.operators.insights import top_rows


def summary(rows: DataFrame, by: list[str], measures: dict[str, Column], totals: bool = False) -> DataFrame:
    """Measures per group; with ``totals`` also per prefix of ``by`` and over all."""
    grouped = rows.rollup(*by) if totals else rows.groupBy(*by)
    return grouped.agg(*[c.alias(name) for name, c in measures.items()])


def trending_terms(rows: DataFrame, day: str, text: str, k: int, min_length: int = 4) -> DataFrame:
    """The ``k`` most used terms of each day; equal counts in term order."""
    terms = F.filter(tokens(text), lambda t: F.length(t) >= min_length)
    counts = rows.select(day, F.explode(terms).alias("term")).groupBy(day, "term").agg(F.count(F.lit(1)).alias("n"))
    return top_rows(counts, [day], [F.desc("n"), F.asc("term")], k)
