"""Database tables over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tideline.functions.ids import array_text


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    split_on: str | None = None,
    lower: int = 0,
    upper: int = 0,
    partitions: int = 1,
) -> DataFrame:
    """A table or parenthesised query. ``split_on`` reads value ranges of a numeric column
    in parallel; without it one connection reads everything."""
    if split_on is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    return spark.read.jdbc(url, table, split_on, lower, upper, partitions, properties=properties or {})


def database_rows(df: DataFrame) -> DataFrame:
    """Rows as a database takes them: arrays as ``{a,b}`` text."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    return df.withColumns({name: array_text(F.col(name).cast("array<string>")) for name in arrays}) if arrays else df


def append_rows(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, connections: int = 16) -> None:
    """Append rows over ``connections`` connections. Rows are dealt out for the writing alone, so
    what comes before keeps its own number of tasks."""
    database_rows(df).repartition(connections).write.jdbc(url, table, mode="append", properties=properties or {})
