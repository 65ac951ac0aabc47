"""Streaming operators whose state is kept by Spark's state store.

A batch reads and writes the state of the keys it has rows for and of no others; Spark checkpoints it, restores it
after a failure. A key's rows of one micro-batch are one group,
so bound the micro-batch (``max_files``, ``max_messages``) for hot keys; ``watch`` has handlers that
cut a key's batch into cells instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.operators import breakout
from tideline.operators.candles import usable_price
from tideline.operators.ordered import floor_div, micros, time_id_key
from tideline.session import with_state_store


def _keyed(rows: DataFrame, key: str, state: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    with_state_store(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(state, schema, "append", mode)


class _BreakoutState(StatefulProcessor):
    """The prices since a key's last breakout, the newest ``history`` - 1 of them, as list state."""

    def __init__(self, threshold: float, history: int):
        self.threshold, self.history = threshold, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "us long, price double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["us", "id"], kind="stable")
        kept = list(self.open.get()) if self.open.exists() else []
        us = np.concatenate(([r[0] for r in kept], new["us"])).astype(np.int64)
        price = np.concatenate(([r[1] for r in kept], new["price"])).astype(np.float64)
        ids, out, begin = new["id"].tolist(), [], 0
        # No price of the state is a breakout: it would have closed the episode.
        for at in np.flatnonzero(price >= self.threshold).tolist():
            first = max(begin, at + 1 - self.history)
            out.append((*key, int(us[at]), ids[at - len(kept)], price[at], at + 1 - first, price[first : at + 1].tolist(), us[first : at + 1].tolist()))
            begin = at + 1
        begin = max(begin, len(price) - self.history + 1)
        if begin < len(price):
            self.open.put(list(zip(us[begin:].tolist(), price[begin:].tolist())))
        else:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=["ticker", "us", "id", "price", "history_len", "history", "history_us"])

    def close(self) -> None:
        pass


def breakouts(ticks: DataFrame, threshold: float = breakout.ALERT_THRESHOLD, history: int = breakout.HISTORY) -> DataFrame:
    """Every breakout of a stream of ticks (id, ts, ticker, price) with the prices of its episode.

    The columns are those of ``operators.breakout.alerts_of``. Ticks count in the order (batch, ts, id).
    """
    rows = ticks.filter(usable_price()).select("ticker", micros("ts").alias("us"), "id", "price")
    kind = rows.schema["id"].dataType.simpleString()
    found = _keyed(
        rows, "ticker", _BreakoutState(threshold, history),
        f"ticker string, us long, id {kind}, price double, history_len long, history array<double>, history_us array<long>",
        "none",
    )
    return found.select(
        "ticker", F.timestamp_micros("us").alias("ts"), "id", "price", "history_len", "history",
        F.transform("history_us", F.timestamp_micros).alias("history_ts"),
    )


class _IndicatorState(StatefulProcessor):
    """The last closes of a key for the RSI; the three means and the last values for the MACD."""

    def __init__(self, period: int, levels: tuple[float, float], spans: tuple[int, int, int]):
        self.period, self.levels, self.spans = period, levels, spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closes = handle.getListState("closes", "close double")
        self.means = handle.getValueState("means", "fast double, slow double, signal double, rsi double")

    @staticmethod
    def _cross(before: float | None, now: float | None, level: float) -> str | None:
        if before is None or now is None:
            return None
        before, now = round(before, 9), round(now, 9)
        return "UP" if before <= level < now else "DOWN" if before >= level > now else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("us", kind="stable")
        closes = [r[0] for r in self.closes.get()] if self.closes.exists() else []
        state = self.means.get()
        fast, slow, signal, rsi = state if state is not None else (None, None, 0.0, None)
        a_fast, a_slow, a_signal = (2.0 / (n + 1) for n in self.spans)
        out = []
        for us, close in zip(new["us"].tolist(), new["close"].tolist()):
            before = None if fast is None else fast - slow - signal
            if fast is None:
                fast = slow = close
            else:
                fast += a_fast * (close - fast)
                slow += a_slow * (close - slow)
                signal += a_signal * (fast - slow - signal)
            closes = [*closes, close][-(self.period + 1) :]
            last, rsi = rsi, None
            if len(closes) > self.period:
                change = np.diff(closes)
                gain, loss = np.maximum(change, 0.0).mean(), np.maximum(-change, 0.0).mean()
                rsi = 100.0 if loss == 0 else float(100.0 - 100.0 / (1.0 + gain / loss))
            crossed = [(f"RSI_{level:g}", self._cross(last, rsi, level)) for level in self.levels]
            crossed.append(("MACD", self._cross(before, fast - slow - signal, 0.0)))
            out += [(*key, us, name, way) for name, way in crossed if way]
        self.closes.put([(x,) for x in closes])
        self.means.update((fast, slow, signal, rsi))
        if out:
            yield pd.DataFrame(out, columns=["ticker", "us", "indicator", "cross"])

    def close(self) -> None:
        pass


def indicator_crosses(
    candles: DataFrame, period: int = 14, low: float = 30.0, high: float = 70.0, spans: tuple[int, int, int] = (12, 26, 9)
) -> DataFrame:
    """(ticker, window_start, indicator, cross): RSI and MACD crossings of a stream of final candles.

    Candles of a key must come in the order of their windows, as ``stream_ohlcv`` gives them.
    """
    rows = candles.select("ticker", micros("window_start").alias("us"), "close")
    state = _IndicatorState(period, (low, high), spans)
    found = _keyed(rows, "ticker", state, "ticker string, us long, indicator string, cross string", "none")
    return found.select("ticker", F.timestamp_micros("us").alias("window_start"), "indicator", "cross")


def latest(ticks: DataFrame) -> DataFrame:
    """The newest tick of each ticker so far, for a writer in update mode: a batch gives the tickers it
    changed. Ticks are reduced within tasks first, so a hot ticker costs a row per task."""
    row = F.struct("ts", "id", "price")
    newest = F.max_by(row, time_id_key(ticks.schema))
    return ticks.groupBy("ticker").agg(newest.alias("__row")).select("ticker", "__row.*")


class _ContextState(StatefulProcessor):
    """The latest ``k`` headlines of each open alert of a bucket, given out by a timer when nothing can be added.

    A bucket is one value, its rows as an Arrow stream, read and written once per batch; a call of the
    state store for each alert or row would cost milliseconds. One timer per bucket stands at its earliest
    open alert.
    """

    ROW = {"alert": "string", "ms": "int64", "us": "int64", "headline_id": "string", "headline": "string"}

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "rows binary")

    def _open(self) -> pd.DataFrame:
        kept = self.best.get()
        return pa.ipc.open_stream(kept[0]).read_pandas() if kept else pd.DataFrame(columns=list(self.ROW))

    def _keep(self, rows: pd.DataFrame) -> None:
        if rows.empty:
            self.best.clear()
            return
        table = pa.table({name: pa.array(rows[name], kind) for name, kind in self.ROW.items()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.best.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self._open()
        before = int(kept["ms"].min()) if len(kept) else None
        for new in rows:
            both = pd.concat([kept, new[list(self.ROW)]], ignore_index=True) if len(kept) else new[list(self.ROW)]
            # Ids are padded text, so numbers order as numbers do.
            both = both.sort_values(["us", "headline_id", "headline"], ascending=False, kind="stable")
            kept = both.groupby("alert", sort=False).head(self.k)
        self._keep(kept)
        first = int(kept["ms"].min())
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self._open()
        # The state is in the order of the ranks.
        done = kept["ms"] < timerValues.getCurrentWatermarkInMs()
        found, kept = kept[done], kept[~done]
        self._keep(kept)
        if len(kept):
            self.handle.registerTimer(int(kept["ms"].min()))
        if len(found):
            rank = found.groupby("alert", sort=False).cumcount() + 1
            yield found.assign(rank=rank.astype("int32"))[["alert", "rank", "headline"]]

    def close(self) -> None:
        pass


def interval_context(
    alerts: DataFrame, headlines: DataFrame, keys: list[str], within: int, late_by: str, k: int, buckets: int = 256
) -> DataFrame:
    """(alert, rank, headline): each alert of one stream with the latest ``k`` headlines of another, of equal ``keys``
    and at most ``within`` seconds older, as structs. Both have ts and a whole-number id.

    A stream-stream join: Spark holds rows until the watermark, ``late_by`` behind the slower stream,
    rules out a partner, and drops and counts rows that are later. Keys are met in spans of ``within``
    seconds, so a hot key is many join keys. An alert is answered once, when its headlines are
    complete; one without headlines gives no row, and those still open at the end are not given. The
    answers in the making are kept in ``buckets`` groups of alerts by a hash, which stay as they are for the
    life of a checkpoint.
    """
    length = within * 1_000_000

    def span(ts: str):
        return floor_div(micros(ts), length)

    own = [F.col(c).alias(f"__{c}") for c in keys]
    a = alerts.select(*own, F.struct(*alerts.columns).alias("alert"), F.col("ts").alias("alert_ts")).withWatermark("alert_ts", late_by)
    a = a.withColumn("__span", F.explode(F.array(span("alert_ts") - 1, span("alert_ts"))))
    h = headlines.select(*own, F.struct(*headlines.columns).alias("headline"), F.col("ts").alias("headline_ts")).withWatermark("headline_ts", late_by)
    h = h.withColumn("__span", span("headline_ts"))
    near = F.expr(f"headline_ts <= alert_ts AND headline_ts >= alert_ts - INTERVAL {within} SECONDS")
    same = near
    for c in [f"__{c}" for c in keys] + ["__span"]:
        same = same & (a[c] == h[c])
    pairs = a.join(h, same).select(
        F.to_json("alert").alias("alert"), "alert_ts", F.unix_millis("alert_ts").alias("ms"), micros("headline_ts").alias("us"),
        F.lpad((F.col("headline.id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 21, "0").alias("headline_id"),
        F.to_json("headline").alias("headline"),
    )
    pairs = pairs.withColumn("bucket", F.pmod(F.xxhash64("alert"), F.lit(buckets)).cast("int"))
    found = _keyed(pairs, "bucket", _ContextState(k), "alert string, rank int, headline string", "eventTime")
    return found.select(
        F.from_json("alert", alerts.schema).alias("alert"), "rank", F.from_json("headline", headlines.schema).alias("headline")
    )
