"""Cut-up windows against plain Python over whole series, with a hot key and small cells."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import asof, breakout, candles, indicators
from tideline.operators.sessions import activity_sessions
from tideline.operators.ordered import lookback_blocks, number_rows, range_cells, time_cell, with_lookback

START = dt.datetime(2024, 1, 1)


def series(n=400, seed=3, threshold=90.0):
    """Ticks with one hot key, equal times, gaps, nulls and NaN."""
    rng, rows, at = random.Random(seed), [], START
    for i in range(n):
        at += dt.timedelta(seconds=rng.choice([0, 1, 30, 600, 9000]))
        ticker = rng.choice(["hot"] * 6 + ["cold", None])
        price = rng.choice([None, float("nan")] + [round(rng.uniform(1, 100), 2)] * 18)
        rows.append((i, at, ticker, price))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, ts timestamp, ticker string, price double")


def usable(rows):
    good = [r for r in rows if r[3] is not None and r[3] == r[3]]
    return sorted(good, key=lambda r: (r[1], r[0]))


def by_key(rows):
    out = {}
    for row in rows:
        out.setdefault(row[2], []).append(row)
    return out


@pytest.mark.parametrize("cell", [60, 3600, 10**9])
def test_number_rows(spark, cell):
    rows = series()
    got = {r.id: r.rn for r in number_rows(frame(spark, rows), ["ticker"], ["ts", "id"], time_cell("ts", cell)).collect()}
    want = {}
    for group in by_key(sorted(rows, key=lambda r: (r[1], r[0]))).values():
        want.update({r[0]: i + 1 for i, r in enumerate(group)})
    assert got == want


@pytest.mark.parametrize("block_rows", [4, 7, 10_000])
def test_lookback_windows(spark, block_rows):
    rows = series()
    n = 3
    out = with_lookback(
        frame(spark, rows), ["ticker"], ["ts", "id"], time_cell("ts", 900), n,
        lambda w: {"ids": F.collect_list("id").over(w.rowsBetween(-n, 0))}, block_rows,
    )
    got = {r.id: r.ids for r in out.collect()}
    want = {}
    for group in by_key(sorted(rows, key=lambda r: (r[1], r[0]))).values():
        order = [r[0] for r in group]
        want.update({x: order[max(0, i - n) : i + 1] for i, x in enumerate(order)})
    assert got == want


def test_blocks_are_even_and_bounded(spark):
    rows = spark.range(1000).withColumn("rn", F.col("id") + 1)
    sizes = [r["count"] for r in lookback_blocks(rows, "rn", 5, 100).groupBy("block").count().collect()]
    assert max(sizes) <= 105
    with pytest.raises(ValueError):
        lookback_blocks(rows, "rn", 100, 100)


def brute_breakouts(rows, threshold, history):
    out = {}
    for key, group in by_key(usable(rows)).items():
        kept = []
        for row in group:
            kept.append(row[3])
            if len(kept) > history:
                kept.pop(0)
            if row[3] >= threshold:
                out[row[0]] = (key, list(kept))
                kept.clear()
    return out


@pytest.mark.parametrize("cell,history,threshold", [(60, 100, 90.0), (3600, 3, 97.0), (10**9, 5, 50.0), (600, 100, 1000.0)])
def test_breakout_history(spark, cell, history, threshold):
    rows = series(600)
    got = breakout.breakout_history(frame(spark, rows), time_cell("ts", cell), threshold, history).collect()
    assert {r.id: (r.ticker, r.history) for r in got} == brute_breakouts(rows, threshold, history)
    assert all(r.history_len == len(r.history) and r.price == r.history[-1] for r in got)


def test_breakout_on_the_first_tick_and_at_the_threshold(spark):
    rows = [(1, START, "a", 2000.0), (2, START + dt.timedelta(seconds=1), "a", 1999.99), (3, START, "b", float("nan"))]
    got = breakout.breakout_history(frame(spark, rows), time_cell("ts", 60)).collect()
    assert [(r.id, r.history) for r in got] == [(1, [2000.0])]


def test_price_drop(spark):
    rows = usable(series(300))
    got = {r.id for r in indicators.price_drop(frame(spark, rows), 3600, 0.05).collect()}
    want = set()
    for group in by_key(rows).values():
        for row in group:
            back = [r[3] for r in group if dt.timedelta(0) <= row[1] - r[1] <= dt.timedelta(hours=1)]
            if row[3] < 0.95 * max(back):
                want.add(row[0])
    assert got == want


def candle_rows(n=900, seed=5):
    rng, out, at = random.Random(seed), [], START
    for _ in range(n):
        at += dt.timedelta(minutes=rng.choice([5, 5, 5, 60, 3000]))
        out.append((rng.choice(["hot", "hot", "hot", "cold"]), at, round(rng.uniform(10, 500), 2)))
    return out


def emas(values, span):
    a, x, out = 2 / (span + 1), values[0], []
    for v in values:
        x += a * (v - x)
        out.append(x)
    return out


@pytest.mark.parametrize("cell", [3600, 86_400, 10 * 86_400])
def test_macd_and_ema_follow_the_recurrence(spark, cell):
    rows = candle_rows()
    data = spark.createDataFrame(rows, "ticker string, window_start timestamp, close double")
    got = {(r.ticker, r.window_start): r for r in indicators.macd(data, cell_seconds=cell).collect()}
    one = {(r.ticker, r.window_start): r.x for r in indicators.ema(data, {"x": ("close", 9)}, cell_seconds=cell).collect()}
    assert len(got) == len(rows)
    for ticker in ("hot", "cold"):
        own = [r for r in rows if r[0] == ticker]
        closes = [r[2] for r in own]
        macd = [f - s for f, s in zip(emas(closes, 12), emas(closes, 26))]
        signal, x = [], 0.0
        for m in macd:
            x += 0.2 * (m - x)
            signal.append(x)
        for row, m, s, e in zip(own, macd, signal, emas(closes, 9)):
            found = got[(ticker, row[1])]
            assert found.macd == pytest.approx(m, abs=1e-8) and found.signal_line == pytest.approx(s, abs=1e-8)
            assert one[(ticker, row[1])] == pytest.approx(e, abs=1e-8)


def test_macd_goes_on_from_earlier_values(spark):
    rows = candle_rows(200)
    shape = "ticker string, window_start timestamp, close double"
    whole = indicators.macd(spark.createDataFrame(rows, shape))
    columns = ["ticker", "window_start", "ema_fast", "ema_slow", "signal_line"]
    want = {(r[0], r[1]): r for r in whole.select(columns).collect()}
    first = indicators.macd(spark.createDataFrame(rows[:120], shape)).select(columns).collect()
    last = {}
    for r in sorted(first, key=lambda r: r[1]):
        last[r[0]] = r
    initial = spark.createDataFrame(list(last.values()), whole.select(columns).schema)
    for r in indicators.macd(spark.createDataFrame(rows[120:], shape), initial=initial).select(columns).collect():
        assert list(r)[2:] == pytest.approx(list(want[(r[0], r[1])])[2:], abs=1e-8)


def test_dense_candles_follow_the_recurrence(spark):
    closes = [100 + 10 * math.sin(i / 50) + i % 7 for i in range(8640)]
    rows = [("a", START + dt.timedelta(seconds=10 * i), c) for i, c in enumerate(closes)]
    data = spark.createDataFrame(rows, "ticker string, window_start timestamp, close double")
    got = [r.macd for r in indicators.macd(data).orderBy("window_start").collect()]
    assert got == pytest.approx([f - s for f, s in zip(emas(closes, 12), emas(closes, 26))], abs=1e-8)


@pytest.mark.parametrize("spans", [1, 4, 64])
def test_price_drop_in_many_spans_of_an_hour(spark, spans):
    rng = random.Random(3)
    rows = [(i, START + dt.timedelta(milliseconds=rng.randrange(9_000_000) // 500 * 500), "a", rng.choice([90.0, 95.0, 99.0, 100.0, 101.0])) for i in range(1500)]
    got = {r.id: r.high_before for r in indicators.price_drop(frame(spark, rows), 3600, 0.05, spans=spans).collect()}
    want = {}
    for i, ts, _, price in rows:
        high = max(p for _, t, _, p in rows if ts - dt.timedelta(hours=1) <= t <= ts)
        if price < 0.95 * high:
            want[i] = high
    assert got == want



def test_rsi_is_null_until_the_window_is_full(spark):
    rows = [("a", START + dt.timedelta(minutes=5 * i), 10.0 + i) for i in range(20)]
    data = spark.createDataFrame(rows, "ticker string, window_start timestamp, close double")
    got = sorted((r.window_start, r.rsi, r.signal) for r in indicators.rsi(data).collect())
    assert [g[1] for g in got[:14]] == [None] * 14 and [g[1:] for g in got[14:]] == [(100.0, "overbought")] * 6


@pytest.mark.parametrize("cell", [60, 86_400])
def test_latest_headlines(spark, cell):
    rows = usable(series(300, 8))
    alerts = [r for r in rows if r[0] % 3 == 0]
    stories = [r for r in rows if r[0] % 3]
    out = asof.latest_before(frame(spark, alerts), frame(spark, stories), ["ticker"], time_cell("ts", cell), 4).collect()
    got = {(r.alert.id, r["rank"]): r.headline.id for r in out}
    want = {}
    for a in alerts:
        before = [s for s in stories if s[2] == a[2] and s[1] <= a[1]]
        for rank, s in enumerate(sorted(before, key=lambda s: (s[1], s[0]), reverse=True)[:4], 1):
            want[(a[0], rank)] = s[0]
    assert got == want


def test_candles_ignore_unusable_prices_and_break_ties_by_id(spark):
    rows = [(2, START, "a", 5.0), (1, START, "a", 7.0), (3, START, "a", None), (4, START, "a", float("nan")), (5, START, None, 1.0)]
    got = {r.ticker: r for r in candles.ohlcv(frame(spark, rows), "5 minutes").collect()}
    a = got["a"]
    assert (a.open, a.high, a.low, a.close, a.volume, a.n) == (7.0, 7.0, 5.0, 5.0, 12.0, 2)
    assert got[None].n == 1
    sliding = candles.ohlcv(frame(spark, rows[:1]), "10 minutes", "5 minutes")
    assert sliding.count() == 2


@pytest.mark.parametrize("cell", [60, 1000, 3600, 10**7])
def test_sessions_do_not_depend_on_the_cells(spark, cell):
    rows = series(500, 11) + [(9001, START - dt.timedelta(hours=2), "tie", 1.0), (9002, START - dt.timedelta(hours=1, minutes=50), "tie", 1.0)]
    want = set()
    for key, group in by_key(sorted(rows, key=lambda r: (r[1], r[0]))).items():
        open_session = []
        for row in [*group, None]:
            if open_session and (row is None or row[1] > open_session[-1] + dt.timedelta(seconds=600)):
                want.add((key, open_session[0], open_session[-1], len(open_session)))
                open_session = []
            if row is not None:
                open_session.append(row[1])
    got = activity_sessions(frame(spark, rows), ["ticker"], 600, cell).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_sessions_agree_with_the_session_window_at_the_exact_gap(spark):
    rows = [(i, START + dt.timedelta(seconds=600 * i + (i > 3)), "a", 1.0) for i in range(6)]
    window = frame(spark, rows).groupBy(F.session_window("ts", "10 minutes"), "ticker").count().count()
    assert activity_sessions(frame(spark, rows), ["ticker"], 600).count() == window


def test_range_cells_even_out_a_burst(spark):
    # All ticks of a hot key within one second: no span of time would split them.
    rows = [(i, START + dt.timedelta(microseconds=i * 7), "hot" if i % 4 else "cold", float(i % 97)) for i in range(4000)]
    cells = range_cells(frame(spark, rows), ["ticker"], ["ts", "id"], 16)
    sizes = [r["count"] for r in cells.groupBy("ticker", "cell").count().collect()]
    assert max(sizes) < 1000 and sum(sizes) == 4000
    got = breakout.breakout_history(cells, F.col("cell"), 96.0, 50).collect()
    assert {r.id: (r.ticker, r.history) for r in got} == brute_breakouts(rows, 96.0, 50)
