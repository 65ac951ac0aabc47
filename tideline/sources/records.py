"""JSON, CSV and Parquet records, alone or as named by the catalog."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tideline.functions.ids import EMPTY_FOLDER


def read_json(spark: SparkSession, path: str | list[str], schema: StructType | None = None, multiline: bool = False) -> DataFrame:
    """JSON records; arrays over several lines need ``multiline``. Without a schema one is
    inferred, which reads the data once more."""
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: StructType) -> DataFrame:
    """What ``read`` gives; no rows when the path does not exist. Other errors are raised."""
    try:
        return read()
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def with_file(df: DataFrame, column: str = "file_path") -> DataFrame:
    return df.withColumn(column, F.col("_metadata.file_path"))


def read_partitioned(spark: SparkSession, root: str, schema: StructType | None = None, kind: str = "parquet") -> DataFrame:
    """A Hive-style directory tree; filters on its directory columns skip whole folders."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(kind).load(root)


def plain_path(path: Column, encoded: bool = False) -> Column:
    """A path without the scheme of local files and without a slash at its end. File metadata
    gives paths URI-encoded."""
    if encoded:
        path = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "/+$", "")


def read_catalogued(
    spark: SparkSession,
    hits: DataFrame,
    under: str,
    kind: str,
    schema: StructType | None = None,
    multiline: bool = False,
    levels: Sequence[str] = (),
) -> DataFrame:
    """Rows of all datasets a catalog search found, with ``file_path``; lacking columns are null.

    ``hits`` name files or folders at any depth below ``under``, whatever their suffixes. None of
    them passes through the driver.

    With ``levels``, the Hive-style folder levels below ``under`` from the top, hits are taken apart into
    the levels' values and meet the rows by these, so Spark prunes folders when it runs; a hit that
    names a file also meets the rows by the file's name. There is one scan for each depth of hits
    (at most one more than there are levels), and the rows are not shuffled.

    Without levels file names are listed and met by the hits, and the rows by the files.
    """
    wanted = hits.select(plain_path(F.col("file_path")).alias("__hit")).distinct()
    reader = spark.read.option("multiLine", multiline).option("mergeSchema", kind == "parquet" and schema is None)
    if levels:
        return _read_levels(spark, wanted, under, kind, schema, reader, list(levels))
    reader = reader.option("recursiveFileLookup", True)
    listed = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(under)
    listed = listed.select(plain_path(F.col("path")).alias("__file"), F.col("_metadata.file_path").alias("file_path"))
    steps = F.split("__file", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    files = listed.withColumn("__hit", F.explode(above)).join(wanted, "__hit").select("file_path").distinct()
    rows = with_file((reader.schema(schema) if schema else reader).format(kind).load(under))
    return rows.join(files, "file_path", "left_semi").select(*[c for c in rows.columns if c != "file_path"], "file_path")


def _read_levels(spark, wanted: DataFrame, under: str, kind: str, schema, reader, levels: list[str]) -> DataFrame:
    """The rows below ``under`` that hits of whole paths name, by the values of their folder levels."""
    top = F.concat(plain_path(F.lit(under)), F.lit("/"))
    below = wanted.filter(F.startswith(F.concat("__hit", F.lit("/")), top))
    rest = F.filter(F.split(F.substring(F.concat("__hit", F.lit("/")), F.length(top) + 1, F.lit(1 << 30)), "/"), lambda x: x != "")
    parts = below.select(rest.alias("__steps"))
    depths = sorted(r[0] for r in parts.select(F.size("__steps")).distinct().collect())
    shape = (reader.schema(schema) if schema else reader).format(kind).load(under).schema
    data = [f for f in shape.fields if f.name not in levels]
    # Level values are text, whatever they look like.
    whole = StructType([*data, *[StructField(name, StringType()) for name in levels]])
    names = [f.name for f in (schema or StructType(data)).fields if f.name != "file_path"]
    # A name in a path is percent-encoded where it has to be, like the folders themselves.
    value = lambda i, name: F.try_url_decode(
        F.replace(F.substring(F.get("__steps", F.lit(i)), len(name) + 2, 1 << 20), F.lit("+"), F.lit("%2B"))
    )
    out = None
    for depth in depths:
        mine = parts.filter(F.size("__steps") == depth)
        for above in (d for d in depths if d < depth):
            # What lies below another hit's folder comes with that one.
            upper = parts.filter(F.size("__steps") == above).select(F.col("__steps").alias("__upper"))
            mine = mine.join(upper, F.slice("__steps", 1, above) == F.col("__upper"), "left_anti") if above else mine.limit(0)
        folders = levels[: min(depth, len(levels))]
        keys = mine.select(*[value(i, name).alias(f"__{name}") for i, name in enumerate(folders)], F.get("__steps", F.lit(len(levels))).alias("__name"))
        rows = with_file(reader.schema(whole).format(kind).load(under))
        same = F.lit(True)
        for name in folders:
            same = same & (F.coalesce(rows[name], F.lit(EMPTY_FOLDER)) == keys[f"__{name}"])
        if depth > len(levels):
            rows = rows.withColumn("__file", F.col("_metadata.file_name"))
            same = same & (rows["__file"] == keys["__name"])
        found = rows.join(keys, same, "left_semi") if folders else rows
        found = found.select(*names, "file_path")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return with_file(reader.schema(whole).format(kind).load(under)).select(*names, "file_path").limit(0)
    return out


def union_ragged(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; a column some lack is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores when the files give fewer scan tasks than there are cores.

    Worth it before heavy work per row on few large row groups. Data of any size has more
    tasks than cores and comes back as it is. ``keys`` should be nearly unique.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)
