"""Support and resistance levels: turning points of the price, gathered along the price axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.candles import exact_sum
from tideline.operators.ordered import cells_before, in_cells, join_on, out_of_cells, time_cell, with_lookback

KEYS = ("ticker",)
DAY = 86_400


def swing_pivots(candles: DataFrame, width: int = 2, keys: Sequence[str] = KEYS, cell: Column | None = None) -> DataFrame:
    """Candles whose high is above, or low below, those of ``width`` candles on either side.

    (keys, window_start, kind, price, rn), kind being RESISTANCE or SUPPORT; one candle may be both.
    Equal neighbours are no turning points, and neither are the first and last ``width`` candles.
    """

    def sides(w):
        newer, older = w.rowsBetween(1 - width, 0), w.rowsBetween(-2 * width, -width - 1)
        return {
            "__at_start": F.lag("window_start", width).over(w),
            "__high": F.lag("high", width).over(w),
            "__low": F.lag("low", width).over(w),
            "__highs": F.greatest(F.max("high").over(newer), F.max("high").over(older)),
            "__lows": F.least(F.min("low").over(newer), F.min("low").over(older)),
        }

    cell = time_cell("window_start", DAY) if cell is None else cell
    seen = with_lookback(candles, keys, ["window_start"], cell, 2 * width, sides).filter(F.col("rn") > 2 * width)
    turns = F.array(
        F.when(F.col("__high") > F.col("__highs"), F.struct(F.lit("RESISTANCE").alias("kind"), F.col("__high").alias("price"))),
        F.when(F.col("__low") < F.col("__lows"), F.struct(F.lit("SUPPORT").alias("kind"), F.col("__low").alias("price"))),
    )
    return seen.select(
        *keys, F.col("__at_start").alias("window_start"), (F.col("rn") - width).alias("rn"), F.inline(F.array_compact(turns))
    )


def price_levels(
    pivots: DataFrame, gap: float = 0.002, least: int = 2, keys: Sequence[str] = KEYS, cell_width: float = 1.0
) -> DataFrame:
    """Levels: turning points of a key and kind with no step of over ``gap`` (a share of the price) between them.

    (keys, kind, level, low, high, touches, first_seen, last_seen) for those with ``least`` touches or more;
    ``level`` is the mean price. Equal prices are counted first, so a hot key sends a row per price and
    task. Prices are then walked in cells of ``cell_width``, which hold at most that many different prices
    however many turning points there are; where a level begins is carried from cell to cell.
    """
    own = [*keys, "kind"]
    prices = pivots.filter(F.col("price").isNotNull() & ~F.isnan("price")).groupBy(*own, "price").agg(
        F.count(F.lit(1)).alias("n"), F.min("window_start").alias("first_seen"), F.max("window_start").alias("last_seen")
    )
    cells = in_cells(prices, own, F.floor(F.col("price") / cell_width))
    ends = cells.groupBy("__at").agg(F.max("price").alias("__end"))
    before = ends.select("__at", F.max("__end").over(cells_before(own)).alias("__end_before"))
    rising = Window.partitionBy("__at").orderBy("price")
    walked = cells.join(before, "__at").withColumn("__last", F.coalesce(F.lag("price").over(rising), "__end_before"))
    starts = F.col("__last").isNull() | (F.col("price") - F.col("__last") > gap * F.abs("__last"))
    walked = walked.withColumn("__start", F.max(F.when(starts, F.col("price"))).over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    carried = walked.groupBy("__at").agg(F.max("__start").alias("__newest"))
    carried = carried.select("__at", F.max("__newest").over(cells_before(own)).alias("__open"))
    placed = walked.join(carried, "__at").withColumn("__start", F.coalesce("__start", "__open"))
    total = exact_sum("__weighted")
    found = (
        out_of_cells(placed, own)
        .withColumn("__weighted", F.col("price").cast("decimal(28,10)") * F.col("n"))
        .groupBy(*own, "__start")
        .agg(
            (total / F.sum("n")).alias("level"),
            F.min("price").alias("low"),
            F.max("price").alias("high"),
            F.sum("n").alias("touches"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
    )
    return found.filter(F.col("touches") >= least).drop("__start")


def nearest_levels(closes: DataFrame, levels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``closes`` (one row per key with ``close``) with the next level above and below; null where there is none.

    Levels combine in the map tasks after a join with one row per key.
    """
    met = join_on(levels, closes.select(*keys, "close"), keys)
    ends = met.groupBy(*keys).agg(
        F.min(F.when(F.col("level") > F.col("close"), F.col("level"))).alias("next_above"),
        F.max(F.when(F.col("level") < F.col("close"), F.col("level"))).alias("next_below"),
    )
    return join_on(closes, ends, keys, "left")
