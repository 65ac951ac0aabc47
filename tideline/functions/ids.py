"""Hashes, row ids, paths, names and placeholder vectors."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMBEDDING_DIM = 1536
BUCKET = "processed-data"
DEFAULT_MIME = "application/octet-stream"

# File extension to MIME type.
MIME_TYPES = {
    "json": "application/json",
    "csv": "text/csv",
    "parquet": "application/parquet",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "mp4": "video/mp4",
    "txt": "text/plain",
    "pdf": "application/pdf",
}

# Pattern of a video link and the length of a video id.
VIDEO_URL = r"^.*(youtu.be\/|v\/|u\/\w\/|embed\/|watch\?v=|&v=)([^#&?]*).*"
VIDEO_ID_LENGTH = 11


def content_hash(content: Column | str) -> Column:
    return F.sha2(content, 256)


def row_id(scope: Column, schedule: Column, source: Column, content: Column) -> Column:
    """The same row gets the same id in every sink and on every run."""
    return F.sha2(F.concat_ws("\x1f", scope, schedule, source, content), 256)


def placeholder_embedding(content: str = "content", dim: int = EMBEDDING_DIM) -> Column:
    """``dim`` copies of length/1000; zeros for null or empty text."""
    return F.array_repeat(F.coalesce(F.length(content), F.lit(0)) / F.lit(1000.0), dim)


def vector_text(vector: Column) -> Column:
    """A vector as JSON text, the form a text-typed database column takes."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ", "), F.lit("]"))


def array_text(items: Column) -> Column:
    """An id array in the ``{a,b}`` form that SQL databases read."""
    return F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))


def normal_extension(extension: Column) -> Column:
    return F.replace(F.lower(extension), F.lit("."), F.lit(""))


def mime_type(extension: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, normal_extension(extension)), F.lit(DEFAULT_MIME))


def canonical_json(struct_json: Column) -> Column:
    """JSON text with sorted keys, no spaces and ASCII escapes.

    Byte equality matters because the bytes are hashed into asset ids, and Spark's own
    writer formats numbers and escapes differently.
    """

    @F.pandas_udf("string")
    def dump(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"))
        )

    return dump(struct_json)


def asset_path(
    stage: Column, scope: Column, schedule: Column, task: Column, asset_id: Column, extension: Column, bucket: str = BUCKET
) -> Column:
    """``s3a://bucket/stage/scope/schedule/task/asset.ext``"""
    name = F.concat(asset_id, F.lit("."), extension)
    return F.concat_ws("/", F.lit(f"s3a://{bucket}"), stage, scope, schedule, task, name)


# Fixed value: the characters a partition folder's name cannot hold; Spark writes them as %XX.
ESCAPED_IN_FOLDERS = "".join(map(chr, range(1, 32))) + "\"#%'*/:=?\\\x7f{[]^"
EMPTY_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def folder_text(value: str | None) -> str:
    """A partition value as Spark names its folder."""
    return "".join(f"%{ord(c):02X}" if c in ESCAPED_IN_FOLDERS else c for c in value or EMPTY_FOLDER)


def folder_name(value: Column) -> Column:
    """The same for a column."""
    text = F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(EMPTY_FOLDER))
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    odd = lambda c: F.instr(F.lit(ESCAPED_IN_FOLDERS), c) > 0
    escape = lambda c: F.when(odd(c), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.array_join(F.transform(letters, escape), "")


def uri_bucket(uri: str, strict: bool = False) -> Column:
    return _uri_part(uri, 1, strict)


def uri_key(uri: str, strict: bool = False) -> Column:
    return _uri_part(uri, 2, strict)


def _uri_part(uri: str, group: int, strict: bool) -> Column:
    """Part of an s3a uri. Another scheme gives null, or an error when strict."""
    pattern = r"(?s)^s3a://([^/]*)/?(.*)$"
    wrong = F.raise_error(F.lit("Invalid file path format")) if strict else F.lit(None).cast("string")
    return F.when(F.col(uri).startswith("s3a://"), F.regexp_extract(uri, pattern, group)).when(
        F.col(uri).isNotNull(), wrong
    )


def run_name(scope_id: Column, schedule_id: Column) -> Column:
    return F.concat(
        F.lit("dynamic_scope_"),
        F.substring(scope_id.cast("string"), 1, 8),
        F.lit("_sch_"),
        F.substring(schedule_id.cast("string"), 1, 8),
    )


def task_name(task_type: Column, task_id: Column) -> Column:
    return F.concat(F.lower(task_type), F.lit("_"), F.substring(task_id.cast("string"), 1, 8))


def video_id(url: str) -> Column:
    """Id in a video link; null when the link has none of the right length."""
    found = F.regexp_extract(url, VIDEO_URL, 2)
    return F.when(F.length(found) == VIDEO_ID_LENGTH, found)


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")
