"""Breakout alerts and the price history each alert closes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.candles import usable_price
from tideline.operators.insights import top_rows
from tideline.operators.ordered import cells_after, cells_before, in_cells, out_of_cells

# Alert threshold, history length and event type of the watchdog.
ALERT_THRESHOLD = 2000.0
HISTORY = 100
EVENT_TYPE = "BREAKOUT_RESISTANCE"
SOURCE_PREFIX = "STREAMING_FAST_LANE_"


def is_breakout(threshold: float = ALERT_THRESHOLD, price: str = "price") -> Column:
    return usable_price(price) & (F.col(price) >= threshold)


def episodes(
    ticks: DataFrame,
    cell: Column,
    threshold: float = ALERT_THRESHOLD,
    keys: Sequence[str] = ("ticker",),
    order: Sequence[str] = ("ts", "id"),
) -> DataFrame:
    """Ticks with their position ``rn`` in the key and ``alert_rn``, the position of the
    breakout that closes their episode; null while the episode is open.

    A breakout closes an episode; the next tick of the key opens a new one. Each tick takes
    the breakout from its own cell if one is left there, else from the first later cell
    that has one. Only a cell's count and its first breakout travel between cells.
    """
    keys = list(keys)
    # Whether a tick is a breakout is told after the shuffle: so both uses of the cells below
    # want the same columns, and Spark shuffles the ticks once for both.
    hit = is_breakout(threshold)
    cells = in_cells(ticks.filter(usable_price()), keys, cell).select("__at", *order, "price")
    inside = Window.partitionBy("__at")
    # Backwards, so that the frame grows and is evaluated in one pass.
    rest = inside.orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
    numbered = cells.withColumn("__k", F.row_number().over(inside.orderBy(*order))).withColumn(
        "__close", F.last(F.when(hit, F.col("__k")), ignorenulls=True).over(rest)
    )
    summary = numbered.groupBy("__at").agg(
        F.count(F.lit(1)).alias("__n"), F.min(F.when(hit, F.col("__k"))).alias("__first_hit")
    )
    summary = summary.withColumn("__before", F.coalesce(F.sum("__n").over(cells_before(keys)), F.lit(0))).withColumn(
        "__later_hit", F.last(F.col("__before") + F.col("__first_hit"), ignorenulls=True).over(cells_after(keys))
    )
    placed = numbered.join(summary.select("__at", "__before", "__later_hit"), "__at")
    return out_of_cells(placed, keys).select(
        *keys,
        *order,
        "price",
        (F.col("__before") + F.col("__k")).alias("rn"),
        F.coalesce(F.col("__before") + F.col("__close"), F.col("__later_hit")).alias("alert_rn"),
    )


def alerts_of(
    placed: DataFrame, history: int = HISTORY, keys: Sequence[str] = ("ticker",), order: Sequence[str] = ("ts", "id")
) -> DataFrame:
    """One row per breakout with the prices and times of its episode, the last ``history``.

    Episodes share no ticks, so the history rows together are no more than the ticks, and
    no array is longer than ``history``.
    """
    return (
        placed.filter(F.col("alert_rn") - F.col("rn") < history)
        .groupBy(*keys, "alert_rn")
        .agg(
            F.max(F.struct("rn", *order, "price")).alias("__last"),
            F.count(F.lit(1)).alias("history_len"),
            F.array_sort(F.collect_list(F.struct("rn", "price", order[0]))).alias("__ticks"),
        )
        .select(
            *keys,
            *[F.col(f"__last.{c}").alias(c) for c in order],
            F.col("__last.price").alias("price"),
            "history_len",
            F.transform("__ticks", lambda x: x["price"]).alias("history"),
            F.transform("__ticks", lambda x: x[order[0]]).alias("history_ts"),
        )
    )


def open_history(
    placed: DataFrame, history: int = HISTORY, keys: Sequence[str] = ("ticker",), order: Sequence[str] = ("ts", "id")
) -> DataFrame:
    """The last ``history`` ticks of each key's open episode: what later ticks still need."""
    waiting = placed.filter(F.col("alert_rn").isNull())
    return top_rows(waiting, list(keys), [F.desc("rn")], history).select(*keys, *order, "price")


def breakout_history(
    ticks: DataFrame,
    cell: Column,
    threshold: float = ALERT_THRESHOLD,
    history: int = HISTORY,
    keys: Sequence[str] = ("ticker",),
    order: Sequence[str] = ("ts", "id"),
) -> DataFrame:
    """All breakouts of closed data with the prices since the breakout before each."""
    return alerts_of(episodes(ticks, cell, threshold, keys, order), history, keys, order)


def alert_payload(alerts: DataFrame, event_type: str | Column = EVENT_TYPE) -> DataFrame:
    """Trigger message of each alert, as the backend takes it."""
    return alerts.withColumn("event_trigger_source", F.concat(F.lit(SOURCE_PREFIX), F.lit(event_type))).withColumn(
        "override_args",
        F.struct(
            F.col("ticker"),
            F.col("price").alias("trigger_price"),
            F.lit(event_type).alias("event_type"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("detected_at"),
        ),
    )
