"""Order-dependent work on long series without one task per key.

A window partitioned by ticker alone puts a whole ticker into one task, and one ticker may
hold a large share of all ticks. Every function here cuts a key's series into cells (spans
of time) and blocks (spans of row numbers), works inside those, and carries only one small
row per cell across the cuts. Results equal those of the uncut window.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, ShortType, StringType, StructType

from tideline.session import scratch_dir


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column (session time zone UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def floor_div(value: Column, size: int) -> Column:
    """Whole quotient, rounded down, without passing through doubles."""
    size = F.lit(size).cast("long")
    return F.call_function("div", value - F.pmod(value, size), size)


def time_cell(ts: str, seconds: int) -> Column:
    """Number of the span of the given length that holds the timestamp."""
    return floor_div(micros(ts), seconds * 1_000_000)


def with_row_ids(df: DataFrame, row_id: str = "id") -> DataFrame:
    """Rows without an id, or of a table without ids, get a hash of their other columns."""
    own = F.xxhash64(*[c for c in df.columns if c != row_id])
    if row_id not in df.columns:
        return df.withColumn(row_id, own)
    kind = df.schema[row_id].dataType
    own = own.cast("string") if isinstance(kind, StringType) else own.cast(kind)
    return df.withColumn(row_id, F.coalesce(row_id, own))


def time_id_key(schema: StructType, ts: str = "ts", row_id: str = "id") -> Column:
    """A key that orders rows by (ts, id).

    For whole-number ids it is one exact decimal, ts * 2^64 + id + 2^63: aggregates can
    update that in place and stay hash based, where a struct key makes Spark sort.
    """
    if not isinstance(schema[row_id].dataType, (LongType, IntegerType, ShortType)):
        return F.struct(ts, row_id)
    high = micros(ts).cast("decimal(18,0)") * F.lit(Decimal(2**64))
    return high + (F.col(row_id).cast("decimal(20,0)") + F.lit(Decimal(2**63)))


def range_cells(df: DataFrame, keys: Sequence[str], order: Sequence[str], cells: int, out: str = "cell") -> DataFrame:
    """Rows with cells of even size, whatever their distribution, from range partitioning.

    For series whose bursts leave no span of time short enough. The partitions come from
    samples, so the rows are written to the shared scratch folder once and every later use
    reads the same cells. ``F.col(out)`` is then a cell for the functions below.
    """
    path = scratch_dir(df.sparkSession, "cells")
    ranged = df.repartitionByRange(cells, *keys, *order).withColumn(out, F.spark_partition_id().cast("long"))
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; key columns are kept once."""
    renamed = right.select([F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for key in keys:
        term = F.col(key).eqNullSafe(F.col(f"__{key}"))
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def in_cells(df: DataFrame, keys: Sequence[str], cell: Column) -> DataFrame:
    """Replace the key columns by ``__at``, the key and its cell as one struct.

    A struct is never null and equal to one with nulls in the same places, so windows,
    aggregates and plain joins on it all want the same partitioning: joining a cell's
    values back to its rows does not shuffle the rows again.
    """
    return df.withColumn("__at", F.struct(*[F.col(k) for k in keys], cell.alias("__cell"))).drop(*keys)


def out_of_cells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key columns back in place of ``__at``."""
    return df.select(*[F.col(f"__at.{k}").alias(k) for k in keys], *[c for c in df.columns if c != "__at"])


def cells_before(keys: Sequence[str]) -> WindowSpec:
    """The cells of each key before the row's own, for a table with one row per cell."""
    return _along(keys, F.asc("__at.__cell"))


def cells_after(keys: Sequence[str]) -> WindowSpec:
    """The cells after the row's own, from the last to the next.

    Ordered backwards: Spark evaluates a frame that only grows in one pass, but one that
    shrinks towards the end (``currentRow`` to ``unboundedFollowing``) anew for each row.
    """
    return _along(keys, F.desc("__at.__cell"))


def _along(keys: Sequence[str], order: Column) -> WindowSpec:
    key = [F.col(f"__at.{k}") for k in keys]
    return Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Column, out: str = "rn"
) -> DataFrame:
    """Position 1..n of each row within its key, in the given order.

    ``cell`` must not decrease along the order. Rows are numbered within (key, cell); the
    rows before each cell come from a table with one row per cell.

    Both sides come from one shuffle, and so from one run of what ``df`` is made by. Spark
    reuses a shuffle only for equal columns, and drops those a side does not read. So each cell
    carries a checksum of all its columns, which both sides read and the join compares.
    """
    cells = in_cells(df, keys, cell)
    inside = Window.partitionBy("__at")
    checksum = F.max(F.xxhash64(*[F.col(c) for c in cells.columns])).over(inside)
    numbered = cells.withColumn("__local", F.row_number().over(inside.orderBy(*order))).withColumn("__sum", checksum)
    sizes = numbered.groupBy("__at").agg(F.max("__local").cast("long").alias("__n"), F.max("__sum").alias("__seen"))
    offsets = rows_before(sizes, keys, "__seen")
    placed = numbered.join(offsets, "__at").filter("__sum <= __seen").withColumn(out, F.col("__before") + F.col("__local"))
    return out_of_cells(placed.drop("__local", "__before", "__sum", "__seen"), keys)


def rows_before(sizes: DataFrame, keys: Sequence[str], *rest: str) -> DataFrame:
    """``__before``, the sum of ``__n`` over the cells before each one of its key."""
    return sizes.select("__at", *rest, F.coalesce(F.sum("__n").over(cells_before(keys)), F.lit(0)).alias("__before"))


def lookback_blocks(df: DataFrame, rn: str, lookback: int, block_rows: int = 50_000) -> DataFrame:
    """Cut numbered rows into even blocks, each led by copies of the rows just before it.

    Adds ``block`` and ``own``. A window over (key, block) with at most ``lookback``
    preceding rows is then exact for rows with ``own``; the copies are dropped afterwards.
    """
    if not 0 <= lookback < block_rows:
        raise ValueError("lookback must be smaller than block_rows")
    position = F.col(rn).cast("long") - 1
    home = floor_div(position, block_rows)
    near_end = F.pmod(position, F.lit(block_rows)) >= block_rows - lookback
    return (
        df.withColumn("__home", home)
        .withColumn("block", F.explode(F.when(near_end, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home"))))
        .withColumn("own", F.col("block") == F.col("__home"))
        .drop("__home")
    )


def with_lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Column,
    lookback: int,
    build,
    block_rows: int = 50_000,
) -> DataFrame:
    """Add window columns that look at most ``lookback`` rows back.

    ``build(window)`` gets an ordered window spec (no frame) and returns {name: Column}.
    A dict's columns may not use one another; ``build`` may also return a list of dicts,
    applied in turn. ``rn`` (position within the key) is available to them.
    """
    numbered = number_rows(df, keys, order, cell)
    blocks = lookback_blocks(numbered, "rn", lookback, block_rows)
    window = Window.partitionBy(*keys, "block").orderBy("rn")
    steps = build(window)
    for step in steps if isinstance(steps, list) else [steps]:
        blocks = blocks.withColumns(step)
    return blocks.filter("own").drop("own", "block")
