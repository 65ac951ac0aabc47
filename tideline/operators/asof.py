"""As-of context: the latest headlines before each alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ordered import in_cells, join_on, out_of_cells, rows_before


def latest_before(
    alerts: DataFrame, headlines: DataFrame, keys: list[str], cell: Column, k: int | str, order: tuple[str, str] = ("ts", "id")
) -> DataFrame:
    """Each alert with its ``k`` latest headlines at or before its time; rank 1 is the latest.

    ``k`` may name a column of the alerts, for a number of its own; null or below one asks for none.

    Both sides run through one ordering, cut by ``cell``, that counts the headlines so far.
    An alert that has seen h of them wants numbers h, h-1, ... and finds these by equality,
    so no pairs beyond the wanted ones are formed. Headlines come back as ``headline``.
    Counting, sizes and numbers share one shuffle, as in ``number_rows``.
    """
    ts, row_id = order
    keys = list(keys)

    def side(rows: DataFrame, number: int, name: str) -> DataFrame:
        packed = F.struct(*[F.col(c) for c in rows.columns]).alias(name)
        return rows.select(*keys, ts, F.lit(number).alias("__side"), F.col(row_id).alias("__id"), packed)

    both = side(alerts, 1, "alert").unionByName(side(headlines, 0, "headline"), allowMissingColumns=True)
    both = in_cells(both, keys, cell)
    inside = Window.partitionBy("__at")
    # A headline at the alert's own time counts as before it, hence the side in the order.
    upto = inside.orderBy(ts, "__side", "__id").rowsBetween(Window.unboundedPreceding, 0)
    checksum = F.max(F.xxhash64(*[F.col(c) for c in both.columns])).over(inside)
    counted = both.withColumn("__local", F.sum(1 - F.col("__side")).over(upto)).withColumn("__sum", checksum)
    sizes = counted.groupBy("__at").agg(F.max("__local").alias("__n"), F.max("__sum").alias("__seen"))
    placed = counted.join(rows_before(sizes, keys, "__seen"), "__at").filter("__sum <= __seen")
    placed = out_of_cells(placed.withColumn("__number", F.col("__before") + F.col("__local")), keys)
    wish = (F.col(f"alert.{k}") if isinstance(k, str) else F.lit(k)).cast("int")
    wanted = (
        placed.filter("__side = 1")
        .withColumn("rank", F.explode(F.when(wish >= 1, F.sequence(F.lit(1), wish))))
        .withColumn("__number", F.col("__number") - F.col("rank") + 1)
        .filter(F.col("__number") >= 1)
        .select(*keys, "alert", "rank", "__number")
    )
    stories = placed.filter("__side = 0").select(*keys, "__number", "headline")
    return join_on(wanted, stories, [*keys, "__number"]).select(*keys, "alert", "rank", "headline")
