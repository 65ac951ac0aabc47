"""Gathering of small files: partitions that many small writes have filled are rewritten as few files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tideline.session import scratch_dir
from tideline.sinks.lake import write_partitions


def as_folders(spark: SparkSession, root: str, by: Sequence[str]) -> DataFrame:
    """A Parquet lake with its folder levels as the texts they are, so ``01`` is not read as 1."""
    known = spark.read.parquet(root).schema
    fields = [StructField(f.name, StringType()) if f.name in by else f for f in known]
    return spark.read.schema(StructType(fields)).parquet(root)


def partition_files(spark: SparkSession, root: str, by: Sequence[str], small_bytes: int) -> DataFrame:
    """(by, files, small_files, bytes) of each partition, from the listing alone: no file is opened."""
    levels = StructType([StructField("path", StringType()), *[StructField(c, StringType()) for c in by]])
    plain = spark.read.format("binaryFile").load(root).schema
    schema = StructType([f for f in plain if f.name not in by] + levels.fields[1:])
    listed = spark.read.format("binaryFile").schema(schema).load(root).select(*by, "length")
    return listed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("length") < small_bytes).alias("small_files"), F.sum("length").alias("bytes")
    )


def gather(
    spark: SparkSession, root: str, by: Sequence[str], least_files: int = 8, small_bytes: int = 64 << 20, per_round: int = 200
) -> list[tuple]:
    """Rewrite the partitions of a Parquet lake that hold ``least_files`` small files or more.

    Returns the partitions' values. Only these are read (partition filters) and replaced (dynamic overwrite);
    rows stay the same, and a hot partition is split over tasks. They go in rounds of ``per_round``, each
    staged in the shared folder before it replaces anything. A round that failed while replacing can be
    repeated from its staged rows. The list of partitions passes through the driver, which holds
    the lake's whole listing anyway. Nobody may write to these partitions meanwhile, and a
    plan made before must not be run after it. A folder that a streaming file sink writes is refused: its
    readers go by the sink's own log of files.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root, "_spark_metadata")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        raise ValueError(f"{root} is written by a streaming file sink")
    crowded = partition_files(spark, root, by, small_bytes).filter(F.col("small_files") >= least_files)
    picked = [tuple(r) for r in crowded.select(*by).orderBy(*by).collect()]
    for start in range(0, len(picked), per_round):
        rows = as_folders(spark, root, by).filter(_is_one_of(by, picked[start : start + per_round]))
        staged = scratch_dir(spark, "gathered")
        rows.write.parquet(staged)
        write_partitions(spark.read.schema(rows.schema).parquet(staged), root, list(by))
    return picked


def _is_one_of(by: Sequence[str], values: list[tuple]) -> Column:
    each = [reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, value)]) for value in values]
    return reduce(Column.__or__, each)
