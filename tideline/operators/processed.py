"""Processed documents: what cleaning and the indicators know of a ticker at a time, as one nested row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.ordered import join_on

# The documents' form.
FORM = (
    "scope_id string, task_id string, ticker string, timestamp timestamp, "
    "data_points struct<open: double, close: double, rsi: double, financial_ratios: struct<PE: double, DE: double>>"
)
FIELDS = ("scope_id", "task_id", "ticker", "timestamp", "data_points")


def processed_documents(candles: DataFrame, figures: DataFrame, on: Sequence[str], scope_id: Column, task_id: Column, ticker: Column) -> DataFrame:
    """One document per candle: its open and close, its RSI and the ratios known for ``on``.

    ``candles`` come with ``rsi``; ``figures`` has ``pe`` and ``de``, one row per value of ``on``. A candle
    without figures keeps its document, with null ratios. A hot key is on the left of the join, so AQE
    can split it.
    """
    found = join_on(candles, figures.select(*on, "pe", "de"), list(on), "left")
    ratios = F.struct(F.col("pe").cast("double").alias("PE"), F.col("de").cast("double").alias("DE"))
    points = F.struct(
        *[F.col(c).cast("double").alias(c) for c in ("open", "close", "rsi")], ratios.alias("financial_ratios")
    )
    return found.select(
        scope_id.cast("string").alias("scope_id"), task_id.cast("string").alias("task_id"), ticker.cast("string").alias("ticker"),
        F.col("window_start").cast("timestamp").alias("timestamp"), points.alias("data_points"),
    )


def save_processed(documents: DataFrame, path: str) -> None:
    """Replace the documents of the tasks that ``documents`` has rows for; a large task takes many files."""
    writer = documents.hint("rebalance", "task_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("task_id").json(path)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Documents in their fixed form, so that a field which is null everywhere stays a column."""
    return spark.read.schema(FORM).json(path).select(*FIELDS)
