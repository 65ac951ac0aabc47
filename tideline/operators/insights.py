"""Insight documents: average price, label, chart series, assembly and the newest one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import blocks
from tideline.operators.candles import exact_sum
from tideline.operators.ordered import floor_div, number_rows


def average_price(rows: DataFrame, keys: list[str], price: str = "price", has_price: Column | None = None) -> DataFrame:
    """Sum of prices over all rows, null prices included in the count; 0 without rows.

    ``has_price`` marks rows of files that have a price column. Other rows count for
    nothing, but their keys stay, with an average of 0.
    """
    counts = F.lit(True) if has_price is None else has_price
    used = rows.withColumn("__price", F.when(counts, F.col(price))).withColumn("__used", F.when(counts, 1))
    return used.groupBy(*keys).agg(
        F.coalesce(F.try_divide(exact_sum("__price"), F.count("__used")), F.lit(0.0)).alias("average_price"),
        F.count("__used").alias("row_count"),
    )


def analysis(averages: DataFrame, bullish_from: float = blocks.BULLISH_FROM) -> DataFrame:
    """Result record of the rule: status, label, rounded average and the rule's name."""
    return averages.select(
        *[c for c in averages.columns if c not in ("average_price",)],
        F.lit("success").alias("status"),
        blocks.price_label(F.col("average_price"), bullish_from).alias("sentiment"),
        F.round("average_price", 2).alias("average_price"),
        F.lit("rule_based_average").alias("logic_used"),
    )


def chart_points(rows: DataFrame, time: Column, price: Column) -> DataFrame:
    """Chart points with ``N/A`` for an absent time and 0 for an absent price."""
    return rows.withColumn(
        "point",
        F.struct(F.coalesce(time.cast("string"), F.lit("N/A")).alias("time"), F.coalesce(price, F.lit(0.0)).alias("price")),
    )


def chart_series(
    points: DataFrame, keys: list[str], order: list[str], cell: Column, rows_per_part: int = 10_000
) -> DataFrame:
    """All points of each key, in order, as arrays of at most ``rows_per_part`` points.

    ``part`` counts the arrays of a key from 0. A short series is one array; a long one is
    several rows, because one array of a whole hot key would not fit one task.
    """
    numbered = number_rows(points, keys, order, cell)
    return (
        numbered.withColumn("part", floor_div(F.col("rn") - 1, rows_per_part))
        .groupBy(*keys, "part")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rn", "point"))), lambda x: x["point"]).alias("data"),
        )
    )


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; combines map-side, unlike a window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def newest_blocks(insights: DataFrame, order: list[str]) -> DataFrame:
    """Blocks of each schedule's newest insight; empty if that one has none."""
    last = newest(insights.select("schedule_id", "blocks", *order), ["schedule_id"], order)
    empty = F.array().cast(insights.schema["blocks"].dataType)
    return last.select("schedule_id", F.coalesce("blocks", empty).alias("blocks"))


def dashboard_documents(series: DataFrame, analyses: DataFrame, keys: list[str]) -> DataFrame:
    """Insight documents: the analysis of each key joined with its price series.

    ``analyses`` has one row per key; reduce several to the newest with ``newest``. A key
    without an analysis is ``Neutral``.
    """
    joined = series.join(analyses.select(*keys, "sentiment"), keys, "left")
    label = F.coalesce("sentiment", F.lit("Neutral"))
    key = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys], F.col("part").cast("string"))
    shown = [*keys, *([] if "ticker" in keys else ["ticker"]), "part"]
    return joined.select(
        *shown,
        label.alias("insight_type"),
        blocks.dashboard_blocks(F.col("ticker"), label, F.col("data"), key).alias("blocks"),
    )


def top_rows(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """First ``k`` rows per key. Spark limits each key in every task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)
