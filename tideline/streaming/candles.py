"""Candles, duplicates, sessions and archives of a tick stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tideline.operators import candles
from tideline.operators.ordered import with_row_ids
from tideline.streaming.run import to_files


def stream_ohlcv(ticks: DataFrame, width: str, late_by: str, slide: str | None = None) -> DataFrame:
    """Candles that are final: each comes out once, when the watermark has passed its end.
    Ticks later than that are dropped."""
    return candles.ohlcv(ticks.withWatermark("ts", late_by), width, slide)


def without_duplicates(ticks: DataFrame, late_by: str, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """Drops redelivered ticks that arrive within ``late_by`` of the first delivery.

    Ticks without an id are told apart by their content."""
    return with_row_ids(ticks).withWatermark("ts", late_by).dropDuplicatesWithinWatermark(list(ids))


def stream_sessions(rows: DataFrame, key: str, gap: str, late_by: str) -> DataFrame:
    """Spans of activity per key that ended: ``gap`` passed without events.

    With local merging (see ``build_session``) a task sends one row per key and session to
    the shuffle. The batch form is ``operators.sessions``.
    """
    return (
        rows.withWatermark("ts", late_by)
        .groupBy(F.session_window("ts", gap).alias("s"), key)
        .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
        .select(key, F.col("s.start").alias("first_ts"), "last_ts", "events")
    )


def archive(ticks: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The raw ticks in the lake, one folder per day and ticker."""
    dated = ticks.withColumn("dt", F.date_format("ts", "yyyy-MM-dd"))
    return to_files(dated, path, checkpoint, ["dt", "ticker"])


def republish(candles_stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Candles as JSON messages for a second topic (a folder of text files here)."""
    message = F.to_json(F.struct(*candles_stream.columns))
    return to_files(candles_stream.select(message.alias("value")), path, checkpoint, kind="text")
