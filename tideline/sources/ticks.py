"""Tick messages as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.schemas import TICK


def message_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of text lines (``value``) from files arriving under a path, oldest first."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def message_topic(spark: SparkSession, servers: str, topic: str, max_messages: int | None = None) -> DataFrame:
    """Stream of message bodies (``value``) from a Kafka topic. Needs the Kafka connector jar."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_messages is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_messages)
    return reader.load().select(F.col("value").cast("string").alias("value"), "partition", "offset")


# A usable price fits the exact sums of the candles, a usable time the years to 9999.
PRICE_BELOW = 1e18
SECONDS_BELOW = 253_402_300_800.0


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with the tick they hold and ``bad``: not a tick, or without a usable price or
    time (null, NaN, infinite, out of range). No later step can fail on a good one.

    The event time is the message's ``timestamp``, seconds since 1970 with a fraction. A message
    need not have an id; then it is a hash of its content and, where the source gives them, of
    its partition and offset, so that a redelivered message keeps its id.
    """
    rows = messages.withColumn("tick", F.from_json("value", TICK))

    def inside(name: str, bound: float):
        # NaN and the infinities are above any bound.
        return F.coalesce(F.abs(F.col(f"tick.{name}")) < bound, F.lit(False))

    usable = F.col("tick.ticker").isNotNull() & inside("price", PRICE_BELOW) & inside("timestamp", SECONDS_BELOW)
    return rows.withColumn("bad", ~F.coalesce(usable, F.lit(False)))


def good_ticks(rows: DataFrame) -> DataFrame:
    micros = F.round(F.col("tick.timestamp") * 1_000_000).try_cast("long")
    place = [c for c in ("partition", "offset") if c in rows.columns]
    own = F.xxhash64("tick.ticker", "tick.timestamp", "tick.price", *place)
    tick_id = F.coalesce("tick.id", own).alias("id")
    return rows.filter(~F.col("bad")).select(tick_id, F.timestamp_micros(micros).alias("ts"), "tick.ticker", "tick.price")


def dead_letters(rows: DataFrame) -> DataFrame:
    return rows.filter("bad").select("value")
