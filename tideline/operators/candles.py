"""Open/high/low/close/volume candles from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordered import time_id_key, with_row_ids


def usable_price(price: str = "price") -> Column:
    """Neither null nor NaN (NaN compares above every number)."""
    return F.col(price).isNotNull() & ~F.isnan(price)


def exact_sum(price: str = "price") -> Column:
    """Sum to ten decimals without rounding errors, as a double."""
    return F.sum(F.col(price).cast("decimal(28,10)")).cast("double")


def ohlcv(ticks: DataFrame, width: str, slide: str | None = None, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Candles per key and time window; ``volume`` is the summed price, ``n`` the tick count.

    Ticks combine map-side, so a hot ticker sends one partial row per window and task. Open
    and close are decided by (ts, id); ticks without an id get one from their content. The sum
    is exact and so does not depend on the order of rows.
    """
    ticks = with_row_ids(ticks)
    first_last = time_id_key(ticks.schema)
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        ticks.filter(usable_price())
        .groupBy(span.alias("w"), *keys)
        .agg(
            F.min_by("price", first_last).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", first_last).alias("close"),
            exact_sum("price").alias("volume"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(*keys, F.col("w.start").alias("window_start"), "open", "high", "low", "close", "volume", "n")
    )
