"""Autoregressive forecasts: prices regressed on the prices before them, from sums alone."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.indicators import DAY, KEYS
from tideline.operators.ordered import join_on, time_cell, with_lookback


def with_lags(candles: DataFrame, order: int, price: str = "close", keys: Sequence[str] = KEYS) -> DataFrame:
    """Candles with their number ``rn`` and ``lags``, the ``order`` prices before, the latest first; null
    for the first candles of a key and where one of the prices is null."""

    def build(w):
        lags = F.array(*[F.lag(price, i).over(w) for i in range(1, order + 1)])
        return [{"lags": lags}, {"lags": F.when(F.forall("lags", lambda x: x.isNotNull()), F.col("lags"))}]

    return with_lookback(candles, keys, ["window_start"], time_cell("window_start", DAY), order, build)


def fit(rows: DataFrame, order: int, price: str = "close", keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n, intercept, weights): least squares of the price on an intercept and its lags, per key.

    Only the sums of products leave the tasks, so a key's length does not matter; one row per key is
    solved. Keys with fewer than order + 2 usable rows, or with lags that depend on one another,
    get the solution of least norm. Rows with a null price or lag take no part.
    """
    keys = list(keys)
    usable = rows.filter(F.col(price).isNotNull() & F.col("lags").isNotNull())
    x = [F.lit(1.0), *[F.get("lags", F.lit(i)) for i in range(order)]]
    pairs = [(i, j) for i in range(order + 1) for j in range(i, order + 1)]
    sums = usable.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("gram"),
        F.array(*[F.sum(x[i] * F.col(price)) for i in range(order + 1)]).alias("moment"),
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys).schema.fields)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for gram, moment in zip(batch["gram"], batch["moment"]):
                whole = np.zeros((order + 1, order + 1))
                for (i, j), value in zip(pairs, gram):
                    whole[i, j] = whole[j, i] = value
                found.append(np.linalg.lstsq(whole, np.asarray(moment, dtype=np.float64), rcond=1e-13)[0])
            out = batch[[*keys, "n"]].copy()
            out["intercept"] = [float(w[0]) for w in found]
            out["weights"] = [w[1:] for w in found]
            yield out

    return sums.mapInPandas(solve, f"{fields}, n long, intercept double, weights array<double>")


def predicted(lags, order: int):
    """The model's price after these ``lags``, for rows joined with a fit."""
    total = F.col("intercept")
    for i in range(order):
        total = total + F.get("weights", F.lit(i)) * F.get(lags, F.lit(i))
    return total


def forecast(
    candles: DataFrame, order: int = 2, share: float = 0.8, price: str = "close", keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, n_fitted, intercept, weights, n_tested, model_error, last_price_error, next), one row per key.

    The model is fitted on the first ``share`` of a key's candles and tested on the rest, one step
    ahead; errors are root mean squares, beside those of taking the last price as the forecast.
    ``next`` is the model's price for the candle after the last. Untested keys have null errors.
    """
    keys = list(keys)
    rows = with_lags(candles.select(*keys, "window_start", price), order, price, keys)
    sizes = rows.groupBy(*keys).agg(F.max("rn").alias("__n"))
    rows = join_on(rows, sizes, keys).withColumn("__fitted", F.col("rn") <= F.floor(F.col("__n") * F.lit(share)))
    model = fit(rows.filter("__fitted"), order, price, keys)
    joined = join_on(rows, model, keys)
    tested = ~F.col("__fitted") & F.col(price).isNotNull() & F.col("lags").isNotNull()
    square = lambda guess: F.sqrt(F.avg(F.when(tested, F.pow(F.col(price) - guess, F.lit(2.0)))))
    # The lags of the candle to come: the last candle's price, then its lags but the oldest.
    last = F.max_by(F.concat(F.array(price), F.slice("lags", 1, order - 1)) if order > 1 else F.array(price), "rn")
    found = joined.groupBy(*keys).agg(
        F.first("n").alias("n_fitted"), F.first("intercept").alias("intercept"), F.first("weights").alias("weights"),
        F.count_if(tested).alias("n_tested"), square(predicted("lags", order)).alias("model_error"),
        square(F.get("lags", F.lit(0))).alias("last_price_error"), last.alias("__last"),
    )
    return found.withColumn("next", predicted("__last", order)).drop("__last")
