"""Turning points and price levels against plain Python."""

import datetime as dt

import numpy as np
import pytest

from tests.test_ordered import START
from tideline.operators import levels
from tideline.operators.ordered import time_cell

CANDLES = "ticker string, window_start timestamp, high double, low double, close double"


def candle_rows(seed=5):
    rng, rows = np.random.default_rng(seed), []
    # The first key holds most candles, over many days; the null key is a key like others.
    for ticker, n in (("hot", 900), (None, 60), ("short", 4), ("flat", 30)):
        for i in range(n):
            high = 10.0 if ticker == "flat" else round(100 + 5 * rng.normal(), 1)
            rows.append((ticker, START + dt.timedelta(minutes=47 * i), high, high - 1.5, high - 0.5))
    return rows


def plain_pivots(rows, width):
    out = []
    for ticker in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == ticker), key=lambda r: r[1])
        for i in range(width, len(own) - width):
            around = own[i - width : i] + own[i + 1 : i + width + 1]
            if all(own[i][2] > r[2] for r in around):
                out.append((ticker, "RESISTANCE", own[i][1], own[i][2]))
            if all(own[i][3] < r[3] for r in around):
                out.append((ticker, "SUPPORT", own[i][1], own[i][3]))
    return out


def plain_levels(pivots, gap, least):
    out = []
    for key in {p[:2] for p in pivots}:
        own, group = sorted((p for p in pivots if p[:2] == key), key=lambda p: p[3]), []
        for p in [*own, None]:
            if group and (p is None or p[3] - group[-1][3] > gap * abs(group[-1][3])):
                if len(group) >= least:
                    prices, times = [g[3] for g in group], [g[2] for g in group]
                    out.append((*key, round(float(np.mean(prices)), 6), min(prices), max(prices), len(group), min(times), max(times)))
                group = []
            if p is not None:
                group.append(p)
    return out


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_turning_points(spark, width):
    rows = candle_rows()
    found = levels.swing_pivots(spark.createDataFrame(rows, CANDLES), width, cell=time_cell("window_start", 7200))
    got = [(r.ticker, r.kind, r.window_start, r.price) for r in found.collect()]
    assert by_text(got) == by_text(plain_pivots(rows, width))


@pytest.mark.parametrize("gap, least, cell_width", [(0.002, 2, 1.0), (0.002, 1, 0.3), (0.01, 3, 100.0), (0.0, 1, 0.05)])
def test_levels(spark, gap, least, cell_width):
    rows = candle_rows()
    pivots = levels.swing_pivots(spark.createDataFrame(rows, CANDLES))
    found = levels.price_levels(pivots, gap, least, cell_width=cell_width).collect()
    got = [(r.ticker, r.kind, round(r.level, 6), r.low, r.high, r.touches, r.first_seen, r.last_seen) for r in found]
    assert by_text(got) == by_text(plain_levels(plain_pivots(rows, 2), gap, least))


def test_odd_prices_and_empty_tables(spark):
    names = "ticker string, kind string, window_start timestamp, price double"
    odd = [("a", "SUPPORT", START, p) for p in (-5.0, -5.001, 0.0, 0.0, None, float("nan"))]
    got = levels.price_levels(spark.createDataFrame(odd, names), least=1).orderBy("low").collect()
    assert [(r.low, r.high, r.touches) for r in got] == [(-5.001, -5.0, 2), (0.0, 0.0, 2)]
    assert levels.price_levels(spark.createDataFrame([], names)).count() == 0
    assert levels.swing_pivots(spark.createDataFrame([], CANDLES)).count() == 0


def test_nearest_levels(spark):
    known = spark.createDataFrame([("a", 9.0), ("a", 12.0), ("a", 15.0), (None, 3.0)], "ticker string, level double")
    closes = spark.createDataFrame([("a", 12.0), (None, 2.0), ("b", 1.0)], "ticker string, close double")
    got = {r.ticker: (r.next_above, r.next_below) for r in levels.nearest_levels(closes, known).collect()}
    assert got == {"a": (15.0, 9.0), None: (3.0, None), "b": (None, None)}
