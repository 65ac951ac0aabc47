"""Messages to alerts to run requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tideline.operators import breakout
from tideline.streaming.run import committed, each_batch
from tideline.streaming.watch import breakout_handler, split_handler


def watchdog(
    messages: DataFrame, schedules: DataFrame, subscriptions: DataFrame, root: str, cell: Column,
    threshold: float = breakout.ALERT_THRESHOLD, history: int = breakout.HISTORY,
) -> DataStreamWriter:
    """A stream of message bodies (``value``) to dead letters, alerts and run requests.

    A batch is marked below ``root`` once all three are written; ``run.committed_rows`` reads by the marks."""
    alerts = breakout_handler(root, cell, threshold, history, schedules, subscriptions)
    return each_batch(messages, committed(split_handler(root, alerts), root), f"{root}/checkpoint")
