"""Candles, indicators and breakout history over ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import breakout, candles, indicators, levels
from tideline.operators.ordered import micros, time_cell
from tideline.queries.registry import query
from tideline.queries.tables import ticks

STAMP = "yyyy-MM-dd HH:mm:ss"


def _candle_sql(minutes: int) -> str:
    return (
        f"SELECT event_type AS ticker, time_bucket(INTERVAL '{minutes} minutes', ts) AS window_start, "
        'arg_min("value", (ts, event_id)) AS open, max("value") AS high, min("value") AS low, '
        'arg_max("value", (ts, event_id)) AS "close", CAST(sum(CAST("value" AS DECIMAL(18,2))) AS DOUBLE) AS volume, '
        "count(*) AS n FROM events GROUP BY 1, 2"
    )


SHOWN_SQL = "strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start"


def shown(frame, *columns):
    """Window starts as text, so that both engines print them alike."""
    return frame.select("ticker", F.date_format("window_start", STAMP).alias("window_start"), *columns)


def candles_of(spark, sf_dir, width):
    return candles.ohlcv(ticks(spark, sf_dir), width)


@query("ohlcv_5m", f'SELECT ticker, {SHOWN_SQL}, open, high, low, "close", volume, n FROM ({_candle_sql(5)})')
def ohlcv_5m(spark, sf_dir):
    return shown(candles_of(spark, sf_dir, "5 minutes"), "open", "high", "low", "close", "volume", "n")


@query("ohlcv_1m", f'SELECT ticker, {SHOWN_SQL}, open, high, low, "close", volume, n FROM ({_candle_sql(1)})')
def ohlcv_1m(spark, sf_dir):
    return shown(candles_of(spark, sf_dir, "1 minute"), "open", "high", "low", "close", "volume", "n")


@query(
    "moving_average",
    f"""SELECT ticker, {SHOWN_SQL}, round(CASE WHEN rn >= 5 THEN ma END, 6) AS ma FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY window_start) AS rn,
        avg("close") OVER (PARTITION BY ticker ORDER BY window_start ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma
        FROM ({_candle_sql(5)}))""",
)
def moving_average(spark, sf_dir):
    frame = indicators.moving_average(candles_of(spark, sf_dir, "5 minutes"), 5)
    return shown(frame, F.round("ma", 6).alias("ma"))


@query(
    "rsi",
    f"""WITH c AS (SELECT *, row_number() OVER w AS rn, "close" - lag("close") OVER w AS d FROM ({_candle_sql(5)})
          WINDOW w AS (PARTITION BY ticker ORDER BY window_start)),
        g AS (SELECT *, avg(greatest(d, 0.0)) OVER w AS gain, avg(greatest(-d, 0.0)) OVER w AS loss FROM c
          WINDOW w AS (PARTITION BY ticker ORDER BY window_start ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
        r AS (SELECT *, CASE WHEN rn > 14 THEN CASE WHEN loss = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + gain / loss) END END AS rsi FROM g)
        SELECT ticker, {SHOWN_SQL}, round(rsi, 6) AS rsi,
        CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' WHEN rsi IS NOT NULL THEN 'neutral' END AS signal
        FROM r""",
)
def rsi(spark, sf_dir):
    frame = indicators.rsi(candles_of(spark, sf_dir, "5 minutes"))
    return shown(frame, F.round("rsi", 6).alias("rsi"), "signal")


@query(
    "volume_spike",
    f"""SELECT ticker, {SHOWN_SQL}, n, round(m, 6) AS trailing_mean FROM (
        SELECT *, row_number() OVER w AS rn,
        avg(n) OVER (PARTITION BY ticker ORDER BY window_start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m
        FROM ({_candle_sql(60)}) WINDOW w AS (PARTITION BY ticker ORDER BY window_start))
        WHERE rn > 20 AND n >= 1.5 * m""",
)
def volume_spike(spark, sf_dir):
    frame = indicators.volume_spike(candles_of(spark, sf_dir, "60 minutes"), 20, 1.5)
    return shown(frame, "n", F.round("trailing_mean", 6).alias("trailing_mean"))


@query(
    "level_break",
    f"""SELECT ticker, {SHOWN_SQL}, "close", resistance, support,
        CASE WHEN "close" > resistance THEN 'RESISTANCE' ELSE 'SUPPORT' END AS break_type FROM (
        SELECT *, row_number() OVER o AS rn, max(high) OVER w AS resistance, min(low) OVER w AS support
        FROM ({_candle_sql(5)})
        WINDOW o AS (PARTITION BY ticker ORDER BY window_start),
               w AS (PARTITION BY ticker ORDER BY window_start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
        WHERE rn > 20 AND ("close" > resistance OR "close" < support)""",
)
def level_break(spark, sf_dir):
    frame = indicators.level_break(candles_of(spark, sf_dir, "5 minutes"))
    return shown(frame, "close", "resistance", "support", "break_type")


@query(
    "reversal",
    f"""WITH c AS (SELECT *, lag(open) OVER w AS po, lag("close") OVER w AS pc FROM ({_candle_sql(60)})
          WINDOW w AS (PARTITION BY ticker ORDER BY window_start)),
        p AS (SELECT *, CASE WHEN pc < po AND "close" > open AND open <= pc AND "close" >= po THEN 'BULLISH_ENGULFING'
          WHEN pc > po AND "close" < open AND open >= pc AND "close" <= po THEN 'BEARISH_ENGULFING' END AS pattern FROM c)
        SELECT ticker, {SHOWN_SQL}, open, "close", pattern FROM p WHERE pattern IS NOT NULL""",
)
def reversal(spark, sf_dir):
    return shown(indicators.engulfing(candles_of(spark, sf_dir, "60 minutes")), "open", "close", "pattern")


@query(
    "drop_1h",
    """SELECT event_id AS id, ticker, price, high_before FROM (
        SELECT event_id, event_type AS ticker, "value" AS price, max("value") OVER (PARTITION BY event_type ORDER BY ts
          RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS high_before FROM events)
        WHERE price < (1.0 - CAST(0.05 AS DOUBLE)) * high_before""",
)
def drop_1h(spark, sf_dir):
    return indicators.price_drop(ticks(spark, sf_dir)).select("id", "ticker", "price", "high_before")


@query(
    "macd",
    f"""WITH RECURSIVE c AS (SELECT ticker, window_start, "close", row_number() OVER (PARTITION BY ticker ORDER BY window_start) AS rn
          FROM ({_candle_sql(60)})),
        e AS (SELECT ticker, window_start, rn, "close" AS f, "close" AS s, CAST(0 AS DOUBLE) AS g FROM c WHERE rn = 1
          UNION ALL
          SELECT c.ticker, c.window_start, c.rn, e.f + (2.0/13)::DOUBLE * (c."close" - e.f), e.s + (2.0/27)::DOUBLE * (c."close" - e.s),
            e.g + (2.0/10)::DOUBLE * ((e.f + (2.0/13)::DOUBLE * (c."close" - e.f)) - (e.s + (2.0/27)::DOUBLE * (c."close" - e.s)) - e.g)
          FROM e JOIN c ON c.ticker = e.ticker AND c.rn = e.rn + 1)
        SELECT ticker, {SHOWN_SQL}, round(f - s, 6) + 0 AS macd, round(g, 6) + 0 AS signal_line, round(f - s - g, 6) + 0 AS histogram FROM e""",
)
def macd(spark, sf_dir):
    frame = indicators.macd(candles_of(spark, sf_dir, "60 minutes"))
    return shown(frame, *[(F.round(c, 6) + 0).alias(c) for c in ("macd", "signal_line", "histogram")])


@query(
    "breakout_history",
    """WITH t AS (SELECT event_id AS id, ts, event_type AS ticker, "value" AS price FROM events),
        e AS (SELECT *, coalesce(sum(CASE WHEN price >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY ts, id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM t),
        h AS (SELECT *, row_number() OVER (PARTITION BY ticker, episode ORDER BY ts DESC, id DESC) AS back,
          max(price) OVER (PARTITION BY ticker, episode) AS top FROM e),
        k AS (SELECT * FROM h WHERE back <= 100 AND top >= 200)
        SELECT ticker, arg_max(id, (ts, id)) AS id, arg_max(epoch_us(ts), (ts, id)) AS ts_us, arg_max(price, (ts, id)) AS price,
        count(*) AS history_len, string_agg(CAST(price AS VARCHAR), ',' ORDER BY ts, id) AS history
        FROM k GROUP BY ticker, episode""",
)
def breakout_history(spark, sf_dir):
    alerts = breakout.breakout_history(ticks(spark, sf_dir), time_cell("ts", 3600), threshold=200.0)
    return alerts.select(
        "ticker", "id", micros("ts").alias("ts_us"), "price", "history_len",
        F.array_join(F.transform("history", lambda x: x.cast("string")), ",").alias("history"),
    )


# Turning points of the hourly candles, and the levels they gather at.
_LEVEL_SQL = f"""p AS (SELECT *, max(high) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS h1, max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS h2,
            min(low) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l1, min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS l2,
            row_number() OVER w AS rn, count(*) OVER (PARTITION BY ticker) AS n_candles FROM ({_candle_sql(60)}) WINDOW w AS (PARTITION BY ticker ORDER BY window_start)),
        t AS (SELECT ticker, window_start, 'RESISTANCE' AS kind, high AS price FROM p WHERE rn BETWEEN 3 AND n_candles - 2 AND high > h1 AND high > h2
            UNION ALL SELECT ticker, window_start, 'SUPPORT', low FROM p WHERE rn BETWEEN 3 AND n_candles - 2 AND low < l1 AND low < l2),
        g AS (SELECT *, lag(price) OVER (PARTITION BY ticker, kind ORDER BY price, window_start) AS last FROM t),
        i AS (SELECT *, sum(CASE WHEN last IS NULL OR price - last > CAST(0.002 AS DOUBLE) * abs(last) THEN 1 ELSE 0 END)
            OVER (PARTITION BY ticker, kind ORDER BY price, window_start) AS nth FROM g),
        v AS (SELECT ticker, kind, CAST(sum(CAST(price AS DECIMAL(28,10))) AS DOUBLE) / count(*) AS level, min(price) AS low, max(price) AS high,
            count(*) AS touches, min(window_start) AS first_seen, max(window_start) AS last_seen FROM i GROUP BY ticker, kind, nth HAVING count(*) >= 2)"""


@query(
    "price_levels",
    f"""WITH {_LEVEL_SQL} SELECT ticker, kind, round(level, 6) AS level, low, high, touches, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen,
        strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM v""",
)
def price_levels(spark, sf_dir):
    found = levels.price_levels(levels.swing_pivots(candles_of(spark, sf_dir, "60 minutes")))
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")}
    return found.withColumn("level", F.round("level", 6)).withColumns(times)


@query(
    "nearest_levels",
    f"""WITH {_LEVEL_SQL}, c AS (SELECT ticker, arg_max("close", window_start) AS "close" FROM ({_candle_sql(60)}) GROUP BY ticker)
        SELECT c.ticker, c."close", round(min(level) FILTER (level > c."close"), 6) AS next_above, round(max(level) FILTER (level < c."close"), 6) AS next_below
        FROM c LEFT JOIN v USING (ticker) GROUP BY c.ticker, c."close" """,
)
def nearest_levels(spark, sf_dir):
    candles = candles_of(spark, sf_dir, "60 minutes")
    closes = candles.groupBy("ticker").agg(F.max_by("close", "window_start").alias("close"))
    found = levels.nearest_levels(closes, levels.price_levels(levels.swing_pivots(candles)))
    return found.withColumns({c: F.round(c, 6) for c in ("next_above", "next_below")})
