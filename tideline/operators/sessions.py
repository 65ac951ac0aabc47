"""Spans of activity per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ordered import floor_div, in_cells, micros, out_of_cells


def activity_sessions(rows: DataFrame, keys: list[str], gap_seconds: int, cell_seconds: int = 86_400) -> DataFrame:
    """Sessions that end when a key has no event for more than ``gap_seconds``: first, last, count.

    Sessions are first found inside cells. Only the first and the last one of a cell can go
    on in another cell, so only these, at most two rows per cell, are put in order per key
    and joined up; the others are final.
    """
    gap = gap_seconds * 1_000_000
    timed = rows.select(*keys, micros("ts").alias("at"))
    cells = in_cells(timed, keys, floor_div(F.col("at"), cell_seconds * 1_000_000))
    inside = Window.partitionBy("__at").orderBy("at")
    opens = F.coalesce((F.col("at") > F.lag("at").over(inside) + gap).cast("int"), F.lit(1))
    counted = cells.withColumn("opens", opens).withColumn("part", F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = counted.groupBy("__at", "part").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("events")
    )
    local = local.withColumn("parts", F.max("part").over(Window.partitionBy("__at")))
    local = out_of_cells(local, keys)
    edge = (F.col("part") == 1) | (F.col("part") == F.col("parts"))
    measures = ["first_at", "last_at", "events"]
    final = local.filter(~edge).select(*keys, *measures)
    along = Window.partitionBy(*keys).orderBy("first_at")
    fresh = F.coalesce((F.col("first_at") > F.lag("last_at").over(along) + gap).cast("int"), F.lit(1))
    joined = (
        local.filter(edge)
        .withColumn("fresh", fresh)
        .withColumn("chain", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "chain")
        .agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("events").alias("events"))
    )
    return final.unionByName(joined.select(*keys, *measures)).select(
        *keys, F.timestamp_micros("first_at").alias("first_ts"), F.timestamp_micros("last_at").alias("last_ts"), "events"
    )
