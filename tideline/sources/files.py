"""Whole files: bytes, hashes and what their content says about itself."""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import ids, text
from tideline.sources.records import plain_path


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: path, size, hash, extension and MIME type."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    extension = ids.normal_extension(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return reader.load(path).select(
        F.col("path").alias("file_path"),
        F.col("length").alias("size_byte"),
        F.sha2("content", 256).alias("asset_id"),
        extension.alias("extension"),
        ids.mime_type(extension).alias("mime_type"),
        "content",
    )


TABLES = ("csv", "parquet")


def inspect_files(files: DataFrame) -> DataFrame:
    """Add ``attributes``: size, hash algorithm and statistics that fit the file type.

    A file that cannot be read keeps its row, with the failure under ``inspection_error``. All
    types are told apart in one pass over the bytes: text is measured natively, and only the
    bytes of tables go to Python. Images are measured by ``image_stats``.
    """

    @F.pandas_udf("string")
    def table_stats(kinds: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([None if body is None else _measure(kind, body) for kind, body in zip(kinds, bodies)], dtype=object)

    is_table, is_text = F.col("extension").isin(*TABLES), F.col("extension") == "txt"
    read = files.withColumn("text", F.when(is_text, F.try_validate_utf8("content")))
    measured = F.to_json(
        F.struct(
            "extension", text.line_count("text").alias("line_count"), text.word_count("text").alias("word_count"),
            F.lit("utf-8").alias("encoding"),
        )
    )
    broken = F.to_json(F.struct("extension", F.lit("invalid utf-8").alias("inspection_error")))
    custom = (
        F.when(is_table, table_stats("extension", F.when(is_table, F.col("content"))))
        .when(is_text, F.when(F.col("text").isNotNull(), measured).otherwise(broken))
        .otherwise(F.to_json(F.struct("extension")))
    )
    return read.withColumn("attributes", _attributes(custom)).drop("content", "text")


def _attributes(custom: Column) -> Column:
    head = F.to_json(F.struct("size_byte", F.lit("SHA-256").alias("hash_algorithm")))
    return F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"custom_metadata":'), custom, F.lit("}"))


def with_image_stats(inspected: DataFrame, images: DataFrame) -> DataFrame:
    """Inspected files, images with the measures of ``image_stats`` in ``attributes``.

    An image is what could be read as one, or has an image's type; other files stay as they are."""
    measures = ("width", "height", "channels", "aspect_ratio", "inspection_error")
    named = images.select(plain_path(F.col("file_path")).alias("__file"), F.struct(*measures).alias("__image"))
    joined = inspected.withColumn("__file", plain_path(F.col("file_path"))).join(named, "__file", "left")
    custom = F.to_json(F.struct("extension", *[F.col(f"__image.{m}").alias(m) for m in measures]))
    is_image = F.col("__image.width").isNotNull() | (F.col("__image").isNotNull() & F.col("mime_type").startswith("image/"))
    return joined.withColumn("attributes", F.when(is_image, _attributes(custom)).otherwise(F.col("attributes"))).drop("__file", "__image")


def _measure(kind: str, body: bytes) -> str:
    found: dict[str, object] = {"extension": kind}
    try:
        if kind == "parquet":
            import pyarrow.parquet as pq

            footer = pq.ParquetFile(io.BytesIO(body))
            columns, rows = footer.schema_arrow.names, footer.metadata.num_rows
        else:
            lines = csv.reader(io.StringIO(body.decode("utf-8"), newline=""))
            columns = next(lines)
            rows = sum(1 for line in lines if line)
        found.update(columns=list(columns), row_count=rows, column_count=len(columns))
    except Exception as failure:  # noqa: BLE001 - any failure is reported in the row
        found["inspection_error"] = str(failure) or type(failure).__name__
    return json.dumps(found)


def image_stats(spark: SparkSession, path: str) -> DataFrame:
    """Width, height, channels and aspect ratio of images; unreadable ones have nulls."""
    images = spark.read.format("image").option("dropInvalid", False).load(path)
    good = F.col("image.width") > 0
    size = lambda c: F.when(good, F.col(f"image.{c}"))
    return images.select(
        F.col("image.origin").alias("file_path"),
        size("width").alias("width"),
        size("height").alias("height"),
        size("nChannels").alias("channels"),
        F.round(F.try_divide(size("width"), size("height")), 2).alias("aspect_ratio"),
        F.when(~good, "unreadable image").alias("inspection_error"),
    )


def has_column(column: str) -> Column:
    """True for files whose inspected columns include the name."""
    names = F.from_json(F.get_json_object("attributes", "$.custom_metadata.columns"), "array<string>")
    return F.coalesce(F.array_contains(names, column), F.lit(False))
