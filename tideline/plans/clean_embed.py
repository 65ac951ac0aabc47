"""Clean raw records, stamp them and derive lake rows and knowledge embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import ids, text
from tideline.operators.catalog import register_dataset
from tideline.operators.lineage import check_stage
from tideline.session import scratch_dir
from tideline.sinks.lake import partition_path, write_partition


def harmonise(raw: DataFrame, source: Column) -> DataFrame:
    """Fill what a record lacks, row by row, whether its column is absent or null.

    The title falls back to the ticker, the date to the record's timestamp or now, the source
    reference to ``source``; a fallback takes the type of the column it fills. Only the content is
    not filled where its column exists: a null there marks a record that cleaning drops.
    Records without texts, such as prices, name the source instead.
    """

    def first_of(names: Sequence[str], last: Column) -> Column:
        present = [n for n in names if n in raw.columns]
        kind = raw.schema[present[0]].dataType if present else None
        options = [F.col(n) for n in present] + [last]
        return F.coalesce(options[0], *[o if kind is None else o.try_cast(kind) for o in options[1:]])

    named = F.concat(F.lit("Data from "), source)
    return raw.withColumns(
        {
            "content": F.col("content") if "content" in raw.columns else named,
            "title": first_of(["title", "ticker"], F.lit("Unknown Title")),
            "published_date": first_of(["published_date", "timestamp"], F.current_timestamp()),
            "source_reference": first_of(["url"], source),
        }
    )


def clean(
    harmonised: DataFrame, scope_id: Column, schedule_id: Column, tags: Sequence[str] = (), stage: str = "2_ETL",
    dim: int = ids.EMBEDDING_DIM,
) -> DataFrame:
    """Rows with content, with a stable id, a vector and lineage columns; all native."""
    return harmonised.filter(F.col("content").isNotNull()).withColumns(
        {
            "id": ids.row_id(scope_id, schedule_id, F.col("source_reference"), F.col("content")),
            "chunk_text": F.col("content"),
            "embedding": ids.placeholder_embedding("content", dim),
            "created_at": F.current_timestamp(),
            "scope_ids": F.array(scope_id),
            "schedule_ids": F.array(schedule_id),
            "tags": ids.literal_array(tags),
            "stage": F.lit(check_stage(stage)),
        }
    )


def lake_rows(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("id", "title", "content", "published_date", "scope_ids", "schedule_ids")


def knowledge_rows(cleaned: DataFrame) -> DataFrame:
    """The knowledge columns; pieces of texts also keep ``document_id`` and ``chunk``."""
    own = [c for c in ("document_id", "chunk") if c in cleaned.columns]
    return cleaned.select(
        "id", "source_reference", "chunk_text", "embedding", "created_at", "scope_ids", "schedule_ids", "tags", "stage", *own
    )


def chunked(cleaned: DataFrame, size: int, overlap: int = 0, dim: int = ids.EMBEDDING_DIM) -> DataFrame:
    """Cleaned rows cut into pieces of ``size`` characters, each with a vector and an id of its own.

    ``document_id`` is the row's id and ``chunk`` the piece's number from 0. Pieces share ``overlap``
    characters with the next. An empty text gives one empty piece, so no document is lost. Vectors
    are made per piece, after the cut, so that no whole text is sent through a model with a bounded input.
    """
    pieces = cleaned.drop("chunk_text", "embedding").select(
        "*", F.posexplode_outer(text.chunks("content", size, overlap)).alias("__at", "__piece")
    )
    number, piece = F.coalesce("__at", F.lit(0)), F.coalesce("__piece", F.lit(""))
    cut = pieces.withColumns({"document_id": F.col("id"), "chunk": number, "chunk_text": piece}).drop("__at", "__piece")
    return cut.withColumns(
        {
            "id": F.sha2(F.concat_ws("\x1f", "document_id", F.col("chunk").cast("string")), 256),
            "embedding": ids.placeholder_embedding("chunk_text", dim),
        }
    )


def run(
    spark: SparkSession, raw: DataFrame, source: Column, source_name: str, scope_id: str, schedule_id: str,
    lake_path: str, knowledge_path: str, tags: Sequence[str] = (), dim: int = ids.EMBEDDING_DIM,
    chunk_size: int | None = None, overlap: int = 0,
) -> DataFrame:
    """Write lake rows and knowledge rows of one scope and schedule; returns the catalog row.

    The harmonised rows are first written, narrow and columnar, to the shared scratch folder.
    Both sinks read that table, so raw records are parsed once and a lost executor costs no
    more than its own tasks. With ``chunk_size`` the knowledge rows are pieces of that size (``chunked``);
    the lake keeps whole texts. The wide vectors exist only while they are written. Without rows
    the partition is left empty, whatever it held, and registered as such.
    """
    staged = scratch_dir(spark, "harmonised")
    rows = harmonise(raw, source).filter(F.col("content").isNotNull())
    narrow = rows.select("title", "content", "published_date", "source_reference")
    narrow.write.parquet(staged)
    cleaned = clean(spark.read.schema(narrow.schema).parquet(staged), F.lit(scope_id), F.lit(schedule_id), tags, dim=dim)
    write_partition(lake_rows(cleaned), lake_path, scope_id, schedule_id)
    pieces = cleaned if chunk_size is None else chunked(cleaned, chunk_size, overlap, dim)
    write_partition(knowledge_rows(pieces), knowledge_path, scope_id, schedule_id)
    path = partition_path(lake_path, scope_id, schedule_id)
    return register_dataset(
        spark.read.schema(lake_rows(cleaned).schema).parquet(path), "id", f"etl_output_{schedule_id}", path, source_name, "2_ETL", scope_id, schedule_id, tags
    )
