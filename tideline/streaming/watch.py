"""The watchdog: stateful breakout alerts, triggers, dead letters and the latest ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import asof, breakout, indicators, metadata
from tideline.operators.insights import newest, top_rows
from tideline.operators.ordered import micros
from tideline.sinks.lake import latest_version, publish_snapshot, snapshot
from tideline.sources.ticks import dead_letters, good_ticks, parsed

Handler = Callable[[DataFrame, int], None]

# Versions of a state that stay: the newest, and what a repeated batch starts from.
KEPT = 3


def breakout_handler(
    root: str, cell: Column, threshold: float = breakout.ALERT_THRESHOLD, history: int = breakout.HISTORY,
    schedules: DataFrame | None = None, subscriptions: DataFrame | None = None,
) -> Handler:
    """Alerts of each batch, with the price history carried from batch to batch.

    The state is the open history of each ticker, at most ``history`` prices. It is kept as
    a table per batch, so a hot ticker's batch is worked on by many tasks, and a repeated
    batch starts from the same state and writes the same files. With ``schedules`` and
    ``subscriptions`` (ticker, schedule_id) run requests are written too.

    Ticks count in the order (batch, ts, id): a late tick comes after all that arrived in
    earlier batches, as for a worker that reads one message after the other.

    Under ``root``: ``alerts``, ``triggers`` and ``state``.
    """
    order = ("batch", "ts", "id")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("ticker", "ts", "id", "price").withColumn("batch", F.lit(batch_id).cast("long"))
        if batch_id > 0:
            rows = rows.unionByName(snapshot(spark, f"{root}/state", batch_id - 1))
        # Cells go by batch first, as the order does.
        placed = breakout.episodes(rows, F.struct(F.col("batch"), cell.alias("cell")), threshold, order=order).persist()
        try:
            alerts_path = f"{root}/alerts/batch={batch_id}"
            breakout.alerts_of(placed, history).write.mode("overwrite").parquet(alerts_path)
            # A history full of prices needs room for the alert that will close it.
            publish_snapshot(breakout.open_history(placed, history - 1, order=order), f"{root}/state", batch_id, keep=KEPT)
        finally:
            placed.unpersist()
        if schedules is not None and subscriptions is not None:
            runs = trigger_requests(spark.read.parquet(alerts_path), schedules, subscriptions)
            runs.write.mode("overwrite").parquet(f"{root}/triggers/batch={batch_id}")

    return handle


def trigger_requests(alerts: DataFrame, schedules: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Run requests of the schedules that watch each alert's ticker."""
    fired = breakout.alert_payload(alerts).join(subscriptions, "ticker")
    runs = metadata.trigger_runs(fired, schedules)
    return runs.select("id", "schedule_id", "scope_id", "run_name", "event_trigger_source", "override_args")


def split_handler(root: str, then: Handler | None = None) -> Handler:
    """Messages that hold no tick go to ``dead_letters``; the ticks go on to ``then`` or to
    ``ticks``. A bad message is stored once and never holds up the stream."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = parsed(batch).persist()
        try:
            dead_letters(rows).write.mode("overwrite").parquet(f"{root}/dead_letters/batch={batch_id}")
            if then is not None:
                then(good_ticks(rows), batch_id)
            else:
                good_ticks(rows).write.mode("overwrite").parquet(f"{root}/ticks/batch={batch_id}")
        finally:
            rows.unpersist()

    return handle


def latest_handler(root: str) -> Handler:
    """The newest tick of each ticker as a snapshot per batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("ticker", "ts", "id", "price")
        if batch_id > 0:
            rows = rows.unionByName(snapshot(batch.sparkSession, root, batch_id - 1))
        publish_snapshot(newest(rows, ["ticker"], ["ts", "id"]), root, batch_id, keep=KEPT)

    return handle


def context_handler(
    root: str, keys: list[str], cell: Column, k: int, is_alert: Column, is_headline: Column, late_by: int = 3600
) -> Handler:
    """Each alert with the latest ``k`` headlines up to its time, joined by event time.

    One stream carries both. The horizon is ``late_by`` seconds before the newest event time. An
    alert gets a first answer in the batch it arrives in (``context``), from what has arrived by
    then. It is held until the horizon passes it and then answered once more, for good (``final``):
    headlines that arrived after it are in, so for rows that are not behind the horizon the split into
    batches does not matter; which rows are behind it depends on the split, as with any watermark. An alert that is behind the horizon when it arrives goes to ``late`` without an answer. State
    are the open alerts and the headlines after the horizon and per key the last ``k`` before it.

    Event times more than ``late_by`` after the clock do not move the horizon, so one wrong time
    in the far future closes nothing. Under ``root``: ``context``, ``final``, ``late`` and the states
    ``headlines``, ``alerts`` and ``horizon``; ``final_context`` reads them.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            headlines, alerts, open_alerts, passed = rows.filter(is_headline), rows.filter(is_alert), None, None
            if batch_id > 0:
                headlines = headlines.unionByName(snapshot(spark, f"{root}/headlines", batch_id - 1))
                open_alerts = snapshot(spark, f"{root}/alerts", batch_id - 1)
                passed = snapshot(spark, f"{root}/horizon", batch_id - 1).first()[0]
            behind = F.lit(False) if passed is None else micros("ts") <= passed
            alerts.filter(behind).write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
            alerts = alerts.filter(~behind)
            found = asof.latest_before(alerts, headlines, keys, cell, k)
            found.write.mode("overwrite").parquet(f"{root}/context/batch={batch_id}")
            clock = F.unix_micros(F.current_timestamp()) + late_by * 1_000_000
            newest_us = rows.filter(micros("ts") <= clock).agg(F.max(micros("ts"))).first()[0]
            marks = [t for t in (passed, None if newest_us is None else newest_us - late_by * 1_000_000) if t is not None]
            horizon = max(marks, default=None)
            closed = F.lit(False) if horizon is None else micros("ts") <= horizon
            waiting = alerts if open_alerts is None else alerts.unionByName(open_alerts)
            done = asof.latest_before(waiting.filter(closed), headlines, keys, cell, k)
            done.write.mode("overwrite").parquet(f"{root}/final/batch={batch_id}")
            publish_snapshot(waiting.filter(~closed), f"{root}/alerts", batch_id, keep=KEPT)
            recent = headlines.filter(~closed)
            before = top_rows(headlines.filter(closed), keys, [F.desc("ts"), F.desc("id")], k).drop("rank")
            publish_snapshot(recent.unionByName(before.select(*recent.columns)), f"{root}/headlines", batch_id, keep=KEPT)
            publish_snapshot(spark.createDataFrame([(horizon,)], "horizon long"), f"{root}/horizon", batch_id, keep=KEPT)
        finally:
            rows.unpersist()

    return handle


def final_context(spark: SparkSession, root: str, keys: list[str], cell: Column, k: int) -> DataFrame:
    """The final answers below the ``root`` of a ``context_handler``, and those that alerts still
    open would get if the stream ended now."""
    last = latest_version(spark, f"{root}/alerts")
    still = asof.latest_before(snapshot(spark, f"{root}/alerts", last), snapshot(spark, f"{root}/headlines", last), keys, cell, k)
    return spark.read.schema(still.schema).parquet(f"{root}/final/batch=*").unionByName(still)


def indicator_handler(root: str, period: int = 14, low: float = 30.0, high: float = 70.0) -> Handler:
    """RSI and MACD crossings on final candles as they come out.

    Carried per ticker: the last ``period + 2`` candles for the RSI, the three means and the
    last histogram for the MACD. Under ``root``: ``crosses``, ``candles`` and ``means``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = ["ticker", "window_start", "close"]
        # Kept once: every further action would run the candle aggregation again.
        new = batch.select(*columns).persist()
        rows, means, before = new.withColumn("fresh", F.lit(True)), None, None
        if batch_id > 0:
            before = snapshot(spark, f"{root}/candles", batch_id - 1)
            rows = rows.unionByName(before.withColumn("fresh", F.lit(False)))
            means = snapshot(spark, f"{root}/means", batch_id - 1)
        if new.isEmpty():
            # No window closed: the state goes on as it is.
            new.unpersist()
            publish_snapshot(before if before is not None else new, f"{root}/candles", batch_id, keep=KEPT)
            publish_snapshot(means if means is not None else _no_means(new), f"{root}/means", batch_id, keep=KEPT)
            return
        rsi = indicators.rsi(rows, period).filter("fresh").persist()
        macd = indicators.macd(new, initial=means)
        macd = indicators.with_previous(macd, "histogram", initial=means).persist()
        try:
            found = [
                _named(indicators.crosses(rsi, "prev_rsi", "rsi", low), f"RSI_{low:g}"),
                _named(indicators.crosses(rsi, "prev_rsi", "rsi", high), f"RSI_{high:g}"),
                _named(indicators.crosses(macd, "prev_histogram", "histogram", 0.0), "MACD"),
            ]
            every = found[0].unionByName(found[1]).unionByName(found[2])
            every.write.mode("overwrite").parquet(f"{root}/crosses/batch={batch_id}")
            state = macd.select("ticker", "window_start", "ema_fast", "ema_slow", "signal_line", "histogram")
            if means is not None:
                state = state.unionByName(means)
            publish_snapshot(newest(state, ["ticker"], ["window_start"]), f"{root}/means", batch_id, keep=KEPT)
            recent = top_rows(rows.select(*columns), ["ticker"], [F.desc("window_start")], period + 2)
            publish_snapshot(recent.drop("rank"), f"{root}/candles", batch_id, keep=KEPT)
        finally:
            for kept in (macd, rsi, new):
                kept.unpersist()

    return handle


def _no_means(candles: DataFrame) -> DataFrame:
    names = ("ema_fast", "ema_slow", "signal_line", "histogram")
    return candles.select("ticker", "window_start", *[F.lit(0.0).alias(n) for n in names]).limit(0)


def _named(crossings: DataFrame, indicator: str) -> DataFrame:
    return crossings.select("ticker", "window_start", F.lit(indicator).alias("indicator"), "cross")
