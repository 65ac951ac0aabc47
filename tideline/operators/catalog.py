"""The file catalog: derive rows, search, merge and delete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import ids, text
from tideline.operators.lineage import catalog_match, check_stage, lineage_match, metadata_match, stamp

# How many results a search gives, and how many a dashboard asks for.
SEARCH_LIMIT = 50
DASHBOARD_LIMIT = 10

KEPT = ("file_name", "file_path", "mime_type", "size_byte", "compression", "attributes", "schedule_ids", "task_ids", "stage")


def text_assets(df: DataFrame, content: str, scope: str, schedule: str, task: str, extension: str = "txt") -> DataFrame:
    """Catalog rows of text contents, addressed by the hash of their bytes.

    Needs ``stage`` and ``tags`` columns; ``scope``, ``schedule`` and ``task`` name id columns.
    """
    custom = F.struct(
        F.lit(extension).alias("extension"),
        text.line_count(content).alias("line_count"),
        text.word_count(content).alias("word_count"),
        F.lit("utf-8").alias("encoding"),
    )
    size = F.octet_length(content).cast("long")
    asset_id = ids.content_hash(content)
    return df.select(
        asset_id.alias("asset_id"),
        F.concat(asset_id, F.lit(f".{extension}")).alias("file_name"),
        ids.asset_path(F.col("stage"), F.col(scope), F.col(schedule), F.col(task), asset_id, F.lit(extension)).alias("file_path"),
        ids.mime_type(F.lit(extension)).alias("mime_type"),
        size.alias("size_byte"),
        F.lit("NONE").alias("compression"),
        F.to_json(
            F.struct(size.alias("size_byte"), F.lit("SHA-256").alias("hash_algorithm"), custom.alias("custom_metadata"))
        ).alias("attributes"),
        F.col("created_at"),
        F.col("created_at").alias("updated_at"),
        F.array(scope).alias("scope_ids"),
        F.array(schedule).alias("schedule_ids"),
        F.array(task).alias("task_ids"),
        F.col("tags"),
        F.col("stage"),
    )


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge rows by asset: scopes and tags are united, ``updated_at`` moves on, the rest
    stays as first saved (schedule and task ids too).

    One aggregation does it. Array elements are exploded first, so the partial sets that
    map tasks send hold distinct ids only, however many copies of an asset there are.
    """
    rows = existing.unionByName(incoming)
    members = F.concat(
        F.transform(F.coalesce("scope_ids", F.array()), lambda x: F.struct(x.alias("scope"), F.lit(None).cast("string").alias("tag"))),
        F.transform(F.coalesce("tags", F.array()), lambda x: F.struct(F.lit(None).cast("string").alias("scope"), x.alias("tag"))),
    )
    first = F.struct("created_at", *KEPT)
    merged = (
        rows.select("asset_id", "updated_at", first.alias("__first"), F.explode_outer(members).alias("__m"))
        .groupBy("asset_id")
        .agg(
            F.min("__first").alias("__first"),
            F.max("updated_at").alias("updated_at"),
            F.array_sort(F.collect_set("__m.scope")).alias("scope_ids"),
            F.array_sort(F.collect_set("__m.tag")).alias("tags"),
        )
    )
    return merged.select(
        "asset_id", *[F.col(f"__first.{c}").alias(c) for c in ("created_at", *KEPT)], "updated_at", "scope_ids", "tags"
    ).select(*existing.columns)


def search(
    catalog: DataFrame,
    expected: Mapping[str, Any] | None = None,
    *,
    attributes: str = "attributes",
    **ids_given: str | None,
) -> DataFrame:
    match = catalog_match(**ids_given)
    if expected:
        match = match & metadata_match(attributes, expected)
    return catalog.filter(match).select("asset_id", "file_path", "mime_type", "attributes")


def lineage_search(
    rows: DataFrame,
    stage: str,
    scope_ids: Sequence[str] = (),
    schedule_ids: Sequence[str] = (),
    tags: Sequence[str] = (),
    newest_by: Sequence = (),
    limit: int | None = None,
) -> DataFrame:
    """Rows matching the lineage predicate; with ``limit``, the first ones by ``newest_by``."""
    found = rows.filter(lineage_match(stage, scope_ids, schedule_ids, tags))
    if newest_by:
        found = found.orderBy(*newest_by)
    return found if limit is None else found.limit(limit)


def newest_insights(
    insights: DataFrame,
    stage: str,
    scope_ids: Sequence[str] = (),
    schedule_ids: Sequence[str] = (),
    tags: Sequence[str] = (),
    limit: int = SEARCH_LIMIT,
) -> DataFrame:
    """The newest insights that match, as a search page shows them; ``id`` breaks ties."""
    return lineage_search(
        insights, stage, scope_ids, schedule_ids, tags, [F.desc("created_at"), F.asc("id")], limit
    )


def lookup(catalog: DataFrame, asset_id: str) -> DataFrame:
    return catalog.filter(F.col("asset_id") == asset_id).select("file_path", "file_name", "mime_type")


def delete_prefix(
    stage: str,
    scope_id: str | None = None,
    schedule_id: str | None = None,
    task_id: str | None = None,
    asset_id: str | None = None,
    bucket: str = ids.BUCKET,
) -> str:
    """Path prefix of everything below the given level. A level needs all levels above it."""
    check_stage(stage)
    levels = [scope_id, schedule_id, task_id, asset_id]
    given = [bool(x) for x in levels]
    if given != sorted(given, reverse=True):
        raise ValueError("a lower level needs the upper ones")
    parts = [f"s3a://{bucket}", stage, *[x for x in levels[:3] if x]]
    return "/".join(parts) + "/" + (asset_id or "")


def below(prefix: str) -> Column:
    """True for rows under the prefix. The match is literal, not a pattern."""
    return F.coalesce(F.startswith(F.col("file_path"), F.lit(prefix)), F.lit(False))


def delete(catalog: DataFrame, prefix: str) -> DataFrame:
    """Rows that are left; ``catalog.filter(below(prefix)).count()`` tells how many go."""
    return catalog.filter(~below(prefix))


def register_dataset(
    written: DataFrame,
    id_column: str,
    file_name: str,
    path: str,
    source: str,
    stage: str,
    scope_id: str,
    schedule_id: str,
    tags: Sequence[str] = (),
) -> DataFrame:
    """One catalog row for a Parquet dataset, from reading it back.

    Only the row ids are read. Sizes come from the file metadata, and the asset id hashes
    sums over the row ids, so it names the content whatever the files or their order.
    """
    # Two halves of each id's digest, added up as exact decimals.
    digest = F.sha2(F.col(id_column), 256)
    halves = [F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)") for start in (1, 16)]
    files = written.groupBy("_metadata.file_path").agg(
        F.max("_metadata.file_size").alias("size"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(halves[0]).alias("a"),
        F.sum(halves[1]).alias("b"),
    )
    summary = files.agg(
        F.sha2(F.concat_ws(",", F.sum("a").cast("string"), F.sum("b").cast("string"), F.sum("rows").cast("string")), 256).alias("asset_id"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size_byte"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("file_count"),
    )
    row = summary.select(
        "asset_id",
        F.lit(file_name).alias("file_name"),
        F.lit(path).alias("file_path"),
        ids.mime_type(F.lit("parquet")).alias("mime_type"),
        "size_byte",
        F.lit("SNAPPY").alias("compression"),
        F.to_json(F.struct(F.lit(source).alias("source"), "row_count", "file_count")).alias("attributes"),
        F.current_timestamp().alias("created_at"),
        F.current_timestamp().alias("updated_at"),
        F.array().cast("array<string>").alias("task_ids"),
    )
    return stamp(row, stage, scope_id, schedule_id, tags)
