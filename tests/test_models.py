"""The forecast and the text classifier against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.test_ordered import START
from tideline.operators import forecast, naive_bayes
from tideline.queries import REGISTERED


def candle_rows(n=300):
    import datetime as dt

    rng, out = np.random.default_rng(4), []
    for ticker, weights in (("hot", (0.6, -0.3)), (None, (0.9, 0.0))):
        prices = [10.0, 11.0]
        for _ in range(n if ticker else 40):
            prices.append(5 + weights[0] * prices[-1] + weights[1] * prices[-2] + rng.normal())
        out += [(ticker, START + dt.timedelta(minutes=i), float(p)) for i, p in enumerate(prices)]
    return out + [("short", START, 1.0)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_forecast_by_least_squares(spark, order):
    rows = candle_rows()
    frame = spark.createDataFrame(rows, "ticker string, window_start timestamp, close double")
    got = {r.ticker: r for r in forecast.forecast(frame, order).collect()}
    assert set(got) == {"hot", None}, "a key without usable rows has no model"
    for ticker in got:
        y = np.array([p for t, _, p in rows if t == ticker])
        cut = math.floor(len(y) * 0.8)
        x = np.array([[1.0, *[y[t - i] for i in range(1, order + 1)]] for t in range(order, len(y))])
        target = y[order:]
        fitted = np.arange(order, len(y)) < cut
        w = np.linalg.lstsq(x[fitted], target[fitted], rcond=None)[0]
        r = got[ticker]
        assert np.allclose([r.intercept, *r.weights], w, atol=1e-6) and r.n_fitted == fitted.sum() and r.n_tested == (~fitted).sum()
        assert abs(r.model_error - np.sqrt(np.mean((target - x @ w)[~fitted] ** 2))) < 1e-6
        assert abs(r.last_price_error - np.sqrt(np.mean((target - x[:, 1])[~fitted] ** 2))) < 1e-9
        assert abs(r.next - w @ [1.0, *y[::-1][:order]]) < 1e-6
    assert got["hot"].model_error < got["hot"].last_price_error


def test_forecast_beats_the_last_price_on_the_table(spark):
    rows = REGISTERED["price_forecast"].build(spark, SMALL).collect()
    assert rows and all(r.model_error < r.last_price_error for r in rows)


def test_null_prices_and_no_candles(spark):
    shape = "ticker string, window_start timestamp, close double"
    rows = [(t, at, None if i % 17 == 3 else p) for i, (t, at, p) in enumerate(candle_rows())]
    assert {r.ticker for r in forecast.forecast(spark.createDataFrame(rows, shape)).collect()} == {"hot", None}
    assert forecast.forecast(spark.createDataFrame([], shape)).count() == 0


def test_naive_bayes_by_hand(spark):
    rows = [(1, "buy Buy now", 1), (2, "hold it", 0), (3, None, 1), (4, "buy it, it", 0), (5, "", 0), (6, "x", None), (None, "now", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = naive_bayes.fit(frame, "text", "y")
    n = {1: Counter("buy buy now now".split()), 0: Counter("hold it buy it it".split())}
    terms = set(n[0]) | set(n[1])
    weight = {t: math.log((n[1][t] + 1) / (4 + len(terms))) - math.log((n[0][t] + 1) / (5 + len(terms))) for t in terms}
    assert {r.term: round(r.weight, 12) for r in model.collect()} == {t: round(w, 12) for t, w in weight.items()}
    prior = math.log(3 / 3)
    got = {r.doc_id: (round(r.score, 9), r.label) for r in naive_bayes.score(frame, model, "doc_id", "text").collect()}
    for doc_id, text, _ in rows:
        s = prior + sum(weight.get(w.strip(","), 0.0) for w in (text or "").lower().split())
        assert got[doc_id] == (round(s, 9), int(s > 0))


def test_words_are_counted_within_their_row(spark):
    rows = [(1, "b a b, B c a b"), (1, "a"), (2, ""), (3, None), (None, "x x"), (4, "one")]
    counted = naive_bayes.term_counts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = sorted(((r.doc_id or 0, r.term, r.n) for r in counted.collect()))
    assert got == [(0, "x", 2), (1, "a", 1), (1, "a", 2), (1, "b", 4), (1, "c", 1), (4, "one", 1)]
    # Words once crossed the network to be counted, and again to meet the model.
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_naive_bayes_needs_both_labels(spark):
    frame = spark.createDataFrame([(1, "a b", 1), (2, "c", 1)], "doc_id long, text string, y int")
    assert naive_bayes.fit(frame, "text", "y").count() == 0
    got = naive_bayes.score(frame, naive_bayes.fit(frame, "text", "y"), "doc_id", "text")
    assert {(r.doc_id, r.score, r.label) for r in got.collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
    assert naive_bayes.score(frame.limit(0), naive_bayes.fit(frame, "text", "y"), "doc_id", "text").count() == 0


def test_classifier_separates_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = REGISTERED["text_classifier"].build(spark, "/root/testdata/sf0.01").join(labels.filter(F.col("doc_id") % 5 == 0), "doc_id").collect()
    right = sum(r.label == r.toxic for r in rows)
    assert right / len(rows) > 0.8
