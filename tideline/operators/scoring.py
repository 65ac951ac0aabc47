"""User functions over text, rows and series, with native baselines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.ids import literal_array
from tideline.functions.text import tokens


def embed(df: DataFrame, fn: Callable[[pd.Series], pd.Series], text: str = "content", out: str = "embedding") -> DataFrame:
    """Vectors from a user function over batches of texts."""
    return df.withColumn(out, F.pandas_udf(fn, "array<double>")(F.col(text)))


def score_text(df: DataFrame, fn: Callable[[pd.Series], pd.Series], text: str, out: str = "score") -> DataFrame:
    """Numbers from a user model over batches of texts."""
    return df.withColumn(out, F.pandas_udf(fn, "double")(F.col(text)))


def lexicon_score(text: str, positive: Iterable[str], negative: Iterable[str]) -> Column:
    """(positive - negative) / (positive + negative) over the text's words; 0 without any."""
    good, bad = literal_array(positive), literal_array(negative)
    words = tokens(text)
    plus = F.size(F.filter(words, lambda w: F.array_contains(good, w)))
    minus = F.size(F.filter(words, lambda w: F.array_contains(bad, w)))
    return F.coalesce(F.try_divide((plus - minus).cast("double"), plus + minus), F.lit(0.0))


def lexicon_label(score: Column) -> Column:
    return F.when(score > 0, "Bullish").when(score < 0, "Bearish").otherwise("Neutral")


def anomalies(df: DataFrame, keys: Sequence[str], value: str, limit: float = 3.0) -> DataFrame:
    """Rows whose value lies more than ``limit`` standard deviations from its key's mean.

    The statistics combine map-side; the join back is on few rows and AQE splits hot keys.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    z = F.try_divide(F.col(value) - F.col("mean"), F.col("deviation"))
    return df.join(stats, list(keys)).withColumn("z", z).filter(F.abs("z") > limit)


def apply_to_series(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: Sequence[str], block: Column
) -> DataFrame:
    """A user model over each key's series, one bounded block at a time.

    ``block`` (a span of time, say) bounds what one call holds; a whole key is never given.
    """
    return df.withColumn("block", block).groupBy(*keys, "block").applyInPandas(fn, schema)


# A user tool: rows of one stage and its arguments in, rows of the next stage out.
Stage = Callable[[DataFrame, dict[str, str]], DataFrame]


def run_stage(stage: Stage, df: DataFrame, arguments: dict[str, str]) -> DataFrame:
    """Run a tool. It gets the ids it must have and whatever else was passed."""
    missing = [a for a in ("scope_id", "schedule_id", "task_id") if a not in arguments]
    if missing:
        raise ValueError(f"missing arguments: {missing}")
    return stage(df, dict(arguments))
