"""Technical indicators over candles, and rules over ticks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.candles import usable_price
from tideline.operators.ordered import floor_div, in_cells, join_on, micros, out_of_cells, time_cell, with_lookback, with_row_ids

DAY = 86_400
KEYS = ("ticker",)


def moving_average(candles: DataFrame, n: int, price: str = "close", keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of the last ``n`` prices; null until ``n`` candles exist."""

    def build(w):
        mean = F.avg(price).over(w.rowsBetween(-(n - 1), 0))
        return {"ma": F.when(F.col("rn") >= n, mean)}

    return with_lookback(candles, keys, ["window_start"], time_cell("window_start", DAY), n - 1, build)


def rsi(
    candles: DataFrame,
    period: int = 14,
    overbought: float = 70.0,
    oversold: float = 30.0,
    price: str = "close",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Relative strength index with simple means, and the signal it gives.

    Null until ``period`` price changes exist; 100 when there was no loss.
    """
    # A block's first change needs one row more than the means do, and a cross one more.
    build = _rsi_steps(period, overbought, oversold, price)
    frame = with_lookback(candles, keys, ["window_start"], time_cell("window_start", DAY), period + 1, build)
    return frame.drop("change", "gain", "loss")


def _rsi_steps(period: int, overbought: float, oversold: float, price: str):
    def build(w):
        recent = w.rowsBetween(-(period - 1), 0)
        change = F.col(price) - F.lag(price).over(w)
        gain = F.avg(F.greatest("change", F.lit(0.0))).over(recent)
        loss = F.avg(F.greatest(-F.col("change"), F.lit(0.0))).over(recent)
        value = F.when(F.col("loss") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide("gain", "loss")))
        return [
            {"change": change},
            {"gain": gain, "loss": loss},
            {"rsi": F.when(F.col("rn") > period, value)},
            {
                "signal": F.when(F.col("rsi") > overbought, "overbought")
                .when(F.col("rsi") < oversold, "oversold")
                .when(F.col("rsi").isNotNull(), "neutral"),
                "prev_rsi": F.lag("rsi").over(w),
            },
        ]

    return build


def crosses(frame: DataFrame, before: str, now: str, level: float) -> DataFrame:
    """Rows that rise through ``level`` (``UP``) or fall through it (``DOWN``) since the row before.

    Values are compared to nine decimals: closer than that to the level counts as on it.
    """
    was, is_now = F.round(before, 9), F.round(now, 9)
    up = (was <= level) & (is_now > level)
    down = (was >= level) & (is_now < level)
    return frame.withColumn("cross", F.when(up, "UP").when(down, "DOWN")).filter(F.col("cross").isNotNull())


def volume_spike(candles: DataFrame, trailing: int = 20, factor: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Candles whose tick count is at least ``factor`` times the mean of the candles before."""
    frame = with_lookback(candles, keys, ["window_start"], time_cell("window_start", DAY), trailing, _volume_steps(trailing))
    return frame.filter(_spikes(trailing, factor))


def _volume_steps(trailing: int):
    return lambda w: [{"trailing_mean": F.avg("n").over(w.rowsBetween(-trailing, -1))}]


def _spikes(trailing: int, factor: float) -> Column:
    return (F.col("rn") > trailing) & (F.col("n") >= factor * F.col("trailing_mean"))


def level_break(candles: DataFrame, trailing: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Candles closing above the highest high (resistance) or below the lowest low (support)
    of the ``trailing`` candles before."""
    frame = with_lookback(candles, keys, ["window_start"], time_cell("window_start", DAY), trailing, _level_steps(trailing))
    return frame.filter(_breaks(trailing))


def _level_steps(trailing: int):
    def build(w):
        before = w.rowsBetween(-trailing, -1)
        return [
            {"resistance": F.max("high").over(before), "support": F.min("low").over(before)},
            {
                "break_type": F.when(F.col("close") > F.col("resistance"), "RESISTANCE").when(
                    F.col("close") < F.col("support"), "SUPPORT"
                )
            },
        ]

    return build


def _breaks(trailing: int) -> Column:
    return (F.col("rn") > trailing) & F.col("break_type").isNotNull()


def engulfing(candles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Candles whose body wraps the opposite body before them: a reversal pattern."""
    frame = with_lookback(candles, keys, ["window_start"], time_cell("window_start", DAY), 1, _engulfing_steps)
    return frame.filter(F.col("pattern").isNotNull())


def _engulfing_steps(w):
    o, c = F.col("open"), F.col("close")
    po, pc = F.col("prev_open"), F.col("prev_close")
    bullish = (pc < po) & (c > o) & (o <= pc) & (c >= po)
    bearish = (pc > po) & (c < o) & (o >= pc) & (c <= po)
    return [
        {"prev_open": F.lag("open").over(w), "prev_close": F.lag("close").over(w)},
        {"pattern": F.when(bullish, "BULLISH_ENGULFING").when(bearish, "BEARISH_ENGULFING")},
    ]


def rule_alerts(
    candles: DataFrame, period: int = 14, oversold: float = 30.0, overbought: float = 70.0, trailing: int = 20,
    factor: float = 2.0, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """What the candle rules find: keys, ``window_start``, ``event_type``, ``price`` (the close), ``value`` and ``level``.

    Event types: ``VOLUME_SPIKE`` (value: ticks, level: their mean before), ``RESISTANCE`` and ``SUPPORT``
    (the close, the level broken), ``RSI_UP`` (RSI rises through ``oversold``), ``RSI_DOWN`` (it falls through
    ``overbought``; value and level are RSI) and the engulfing patterns (close, close before). A candle may raise
    several. All rules look back from one numbering of the candles, so they cost no more shuffles than one of them.
    """
    steps = [_rsi_steps(period, overbought, oversold, "close"), _volume_steps(trailing), _level_steps(trailing), _engulfing_steps]
    frame = with_lookback(
        candles, keys, ["window_start"], time_cell("window_start", DAY), max(period + 1, trailing),
        lambda w: [step for build in steps for step in build(w)],
    )
    was, now = F.round("prev_rsi", 9), F.round("rsi", 9)

    def event(when: Column, kind: Column, value: str, level) -> Column:
        level = F.col(level) if isinstance(level, str) else F.lit(level)
        return F.when(when, F.struct(kind.alias("event_type"), F.col(value).cast("double").alias("value"), level.cast("double").alias("level")))

    broken = F.when(F.col("break_type") == "SUPPORT", F.col("support")).otherwise(F.col("resistance"))
    found = F.array(
        event(_spikes(trailing, factor), F.lit("VOLUME_SPIKE"), "n", "trailing_mean"),
        event(_breaks(trailing), F.col("break_type"), "close", broken),
        event((was <= oversold) & (now > oversold), F.lit("RSI_UP"), "rsi", oversold),
        event((was >= overbought) & (now < overbought), F.lit("RSI_DOWN"), "rsi", overbought),
        event(F.col("pattern").isNotNull(), F.col("pattern"), "close", "prev_close"),
    )
    events = frame.select(*keys, "window_start", F.col("close").alias("price"), F.explode(F.array_compact(found)).alias("__event"))
    return events.select(*keys, "window_start", "price", "__event.*")


# Spans a look-back is cut into; divides any whole number of seconds in microseconds.
LOOK_BACK_SPANS = 64


def price_drop(
    ticks: DataFrame, seconds: int = 3600, fraction: float = 0.05, keys: Sequence[str] = KEYS, spans: int = LOOK_BACK_SPANS
) -> DataFrame:
    """Ticks priced more than ``fraction`` below the highest price of the last ``seconds``.

    The look-back is cut into ``spans`` (which must divide its microseconds), so no task holds
    an hour of a ticker. What a tick looks back on is its own span up to it, the whole spans
    between, and the end of the span the look-back begins in. Every price is sent along once
    more, a look-back later: in the span it then falls into, the prices still to come are those
    not yet out of sight. So both ends are running maxima of one span, one from each side, and
    ticks are shuffled once. The spans between have one maximum each. Ticks without an id are
    told apart by their content.
    """
    length = seconds * 1_000_000
    if length % spans:
        raise ValueError("spans must divide the look-back")
    keys = list(keys)
    ticks = with_row_ids(ticks.filter(usable_price()))
    rest = [c for c in ticks.columns if c not in keys]
    span = floor_div(micros("ts"), length // spans)
    timed = ticks.select(*keys, F.struct(*rest).alias("tick"), F.col("price").alias("__price"), micros("ts").alias("at"), span.alias("__span"))
    nothing = F.lit(None).cast(timed.schema["tick"].dataType)
    both = F.array(
        F.struct(F.lit(0).cast("long").alias("later"), F.col("tick")), F.struct(F.lit(spans).cast("long").alias("later"), nothing.alias("tick"))
    )
    sent = timed.withColumn("sent", F.explode(both)).select(
        *keys, "__price", "sent.tick", (F.col("at") + F.col("sent.later") * F.lit(length // spans)).alias("at"),
        (F.col("__span") + F.col("sent.later")).alias("__span"),
    )
    inside = Window.partitionBy("__at")
    old = F.when(F.col("tick").isNull(), F.col("__price"))
    back_to = inside.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = inside.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cells = in_cells(sent, keys, F.col("__span")).withColumn("__old", F.max(old).over(back_to)).filter(F.col("tick").isNotNull())
    cells = cells.withColumn("__own", F.max("__price").over(upto))

    tops = in_cells(timed, keys, F.col("__span")).groupBy("__at").agg(F.max("__price").alias("__top"))
    if spans > 1:
        along = Window.partitionBy(*[F.col(f"__at.{k}") for k in keys]).orderBy("__at.__cell")
        between = F.max("__top").over(along.rangeBetween(1 - spans, -1))
    else:
        between = F.lit(None).cast("double")
    joined = cells.join(tops.select("__at", between.alias("__between")), "__at")
    hits = joined.withColumn("high", F.greatest("__old", "__own", "__between")).filter(F.col("__price") < (1.0 - fraction) * F.col("high"))
    return out_of_cells(hits, keys).select(*keys, "tick.*", F.col("high").alias("high_before"))


def ema(
    candles: DataFrame,
    means: dict[str, tuple[str, int]],
    keys: Sequence[str] = KEYS,
    cell_seconds: int = DAY,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Exponential means x_k = x_{k-1} + a (v_k - x_{k-1}), a = 2 / (span + 1), from x_1 = v_1.

    ``means`` maps new columns to (value column, span). The recurrence is affine, so a cell
    of m candles maps the value before it to ``decay^m * before + local``. Cells are reduced
    natively, only the one row per cell is walked in order, and the value before each cell
    is then put back into it. ``initial`` holds the means before the first candle, per key,
    when the candles go on from earlier ones.
    """
    decays = {out: _decay(span) for out, (_, span) in means.items()}
    cells, upto = _cells(candles, keys, cell_seconds, list(decays.values()))
    for out, (value, _) in means.items():
        cells = cells.withColumn(f"__local_{out}", _decayed_sum(F.col(value), decays[out], upto))
    seeds = {out: value for out, (value, _) in means.items()}

    def step(state: dict[str, float], rows: int, local: dict[str, float]) -> dict[str, float]:
        return {out: decay**rows * state[out] + local[out] for out, decay in decays.items()}

    joined = _carried(cells, keys, seeds, step, initial)
    for out, decay in decays.items():
        before = F.pow(F.lit(decay), F.col("__k")) * F.col(f"__before_{out}")
        joined = joined.withColumn(out, before + F.col(f"__local_{out}"))
    return _without_helpers(joined)


def macd(
    candles: DataFrame,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    price: str = "close",
    keys: Sequence[str] = KEYS,
    cell_seconds: int = DAY,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Exponential means over ``fast`` and ``slow`` candles, their difference and its own mean.

    All three are linear in the values before the cell, so one pass over the cells does it:
    a value x before the cell adds ``decay^k x`` to its own mean and a geometric sum of that
    to the signal line. ``initial`` as for ``ema``.
    """
    decays = {"ema_fast": _decay(fast), "ema_slow": _decay(slow), "signal_line": _decay(signal)}
    gamma = decays["signal_line"]
    cells, upto = _cells(candles, keys, cell_seconds, list(decays.values()))
    for out in ("ema_fast", "ema_slow"):
        cells = cells.withColumn(f"__local_{out}", _decayed_sum(F.col(price), decays[out], upto))
    between = F.col("__local_ema_fast") - F.col("__local_ema_slow")
    cells = cells.withColumn("__local_signal_line", _decayed_sum(between, gamma, upto))

    def reach(decay: float, rows):
        """What a unit before the cell, fading by ``decay``, adds to the signal after ``rows``."""
        if math.isclose(decay, gamma):
            return (1.0 - gamma) * rows * gamma**rows
        return (1.0 - gamma) * decay * (decay**rows - gamma**rows) / (decay - gamma)

    def reach_column(decay: float) -> Column:
        k = F.col("__k").cast("double")
        if math.isclose(decay, gamma):
            return (1.0 - gamma) * k * F.pow(F.lit(gamma), k)
        factor = (1.0 - gamma) * decay / (decay - gamma)
        return factor * (F.pow(F.lit(decay), k) - F.pow(F.lit(gamma), k))

    def step(state: dict[str, float], rows: int, local: dict[str, float]) -> dict[str, float]:
        after = {out: decay**rows * state[out] + local[out] for out, decay in decays.items()}
        for out, sign in (("ema_fast", 1), ("ema_slow", -1)):
            after["signal_line"] += sign * state[out] * reach(decays[out], rows)
        return after

    seeds = {"ema_fast": price, "ema_slow": price, "signal_line": 0.0}
    joined = _carried(cells, keys, seeds, step, initial)
    for out, decay in decays.items():
        value = F.pow(F.lit(decay), F.col("__k")) * F.col(f"__before_{out}") + F.col(f"__local_{out}")
        if out == "signal_line":
            for other, sign in (("ema_fast", 1), ("ema_slow", -1)):
                value = value + sign * F.col(f"__before_{other}") * reach_column(decays[other])
        joined = joined.withColumn(out, value)
    joined = joined.withColumn("macd", F.col("ema_fast") - F.col("ema_slow"))
    return _without_helpers(joined.withColumn("histogram", F.col("macd") - F.col("signal_line")))


def _decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1)


def _cells(candles: DataFrame, keys: Sequence[str], seconds: int, decays: list[float]):
    """Candles with their cell and place in it, and the window of a cell up to a candle.

    A cell is a span of ``seconds``, cut on by number within the span (``__part``), so that it holds
    few candles however dense they are: decay^-k must stay inside the range of a double. All windows
    use the spans' shuffle. ``__sum`` lets both uses of the cells share it, as in ``number_rows``.
    """
    rows = min(1000, *(int(600 / -math.log(d)) if d > 0 else 1 for d in decays))
    cells = in_cells(candles, keys, time_cell("window_start", seconds))
    span = Window.partitionBy("__at")
    checksum = F.max(F.xxhash64(*[F.col(c) for c in cells.columns])).over(span)
    place = F.row_number().over(span.orderBy("window_start")).cast("long") - 1
    cells = cells.withColumn("__place", place).withColumns(
        {"__sum": checksum, "__part": floor_div(F.col("__place"), rows), "__k": (F.pmod("__place", F.lit(rows)) + 1).cast("int")}
    )
    upto = Window.partitionBy("__at", "__part").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    return cells.drop("__place"), upto


def _decayed_sum(value: Column, decay: float, upto) -> Column:
    """The cell's mean after each candle if nothing had been before the cell."""
    scaled = F.sum(value * F.pow(F.lit(decay), -F.col("__k"))).over(upto)
    return F.lit(1.0 - decay) * F.pow(F.lit(decay), F.col("__k")) * scaled


def _carried(cells: DataFrame, keys: Sequence[str], seeds: dict[str, str | float], step, initial) -> DataFrame:
    """Add ``__before_<mean>``, the means before each cell.

    ``step(state, rows, local)`` takes the means across one cell; ``seeds`` gives the first
    state as a column of the first candle or a number. Only one row per cell is walked, and one
    row per span, with the states before its parts, comes back to the candles.
    """
    keys = list(keys)
    ends = cells.groupBy("__at", "__part").agg(
        F.max("__k").cast("long").alias("__m"),
        F.max("__sum").alias("__seen"),
        *[F.max_by(f"__local_{out}", "__k").alias(f"__end_{out}") for out in seeds],
        *[
            (F.min_by(seed, "__k") if isinstance(seed, str) else F.first(F.lit(seed))).alias(f"__seed_{out}")
            for out, seed in seeds.items()
        ],
    ).select("__at.*", "*")
    if initial is not None:
        known = initial.select(*keys, *[F.col(out).alias(f"__known_{out}") for out in seeds])
        ends = join_on(ends, known, keys, "left").withColumns(
            {f"__seed_{out}": F.coalesce(f"__known_{out}", f"__seed_{out}") for out in seeds}
        )
    ends = ends.drop("__at")
    fields = ends.select(*keys, "__cell", "__seen").schema.fields
    schema = ", ".join(
        [*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], *[f"__states_{out} array<double>" for out in seeds]]
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__cell", "__part"])
        state = {out: float(pdf[f"__seed_{out}"].iloc[0]) for out in seeds}
        before: list[list[dict[str, float]]] = []
        for row in pdf[["__part", "__m", *[f"__end_{out}" for out in seeds]]].itertuples(index=False):
            if row[0] == 0:
                before.append([])
            before[-1].append(state)
            state = step(state, row[1], dict(zip(seeds, row[2:])))
        walked = pdf.loc[pdf["__part"] == 0, [*keys, "__cell", "__seen"]].reset_index(drop=True)
        return walked.assign(**{f"__states_{out}": [[b[out] for b in parts] for parts in before] for out in seeds})

    carried = ends.groupBy(*keys).applyInPandas(walk, schema)
    carried = in_cells(carried, keys, F.col("__cell")).drop("__cell")
    joined = cells.join(carried, "__at").filter("__sum <= __seen")
    befores = {f"__before_{out}": F.get(f"__states_{out}", F.col("__part").cast("int")) for out in seeds}
    return out_of_cells(joined.withColumns(befores), keys)


def _without_helpers(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("__")])


def ratios(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Named quotients of two columns each; null where the divisor is zero or null."""
    return df.withColumns({name: F.try_divide(F.col(a), F.col(b)) for name, (a, b) in columns.items()})


def price_ratios(df: DataFrame) -> DataFrame:
    """P/E, P/BV and D/E from price, earnings, book value, debt and equity columns."""
    return ratios(
        df, {"pe": ("price", "earnings"), "pbv": ("price", "book_value"), "de": ("debt", "equity")}
    )


def with_previous(
    candles: DataFrame, value: str, keys: Sequence[str] = KEYS, initial: DataFrame | None = None
) -> DataFrame:
    """Add ``prev_<value>``: the value at the candle before, or ``initial``'s at the first."""
    out = f"prev_{value}"
    frame = with_lookback(
        candles, keys, ["window_start"], time_cell("window_start", DAY), 1, lambda w: {out: F.lag(value).over(w)}
    ).drop("rn")
    if initial is not None:
        known = initial.select(*keys, F.col(value).alias("__known"))
        frame = join_on(frame, known, keys, "left").withColumn(out, F.coalesce(out, "__known")).drop("__known")
    return frame
