"""Search, ETL, analysis and display of one lake, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from tideline.functions import blocks, ids
from tideline.operators import catalog, insights
from tideline.session import staged
from tideline.sinks.catalog_store import read_catalog, upsert_catalog
from tideline.sinks.lake import append_insights, read_records, record_levels, save_records, write_partitions
from tideline.sources.records import read_catalogued

# Fixed value: what the basic ETL step stores in place of a vector.
VECTOR_PLACEHOLDER = "mock_vector_placeholder"
LEVELS = ["stage", "scope", "schedule", "task"]


def save(rows: DataFrame, root: str, kind: str) -> None:
    """Store rows with ``stage, scope, schedule, task`` columns, one folder per combination."""
    write_partitions(rows, root, LEVELS, kind)


def folder_catalog(spark: SparkSession, root: str, stage: str, kind: str, shape: StructType, created_at: Column) -> DataFrame:
    """Catalog rows of a stage's folders, from one reading of what ``save`` wrote there.

    Sizes are the files' own. The asset id hashes sums over the rows, so it names the content
    whatever the files or their order.
    """
    levels = [StructField(name, StringType()) for name in LEVELS[1:]]
    rows = spark.read.schema(StructType([*shape.fields, *levels])).format(kind).load(f"{root}/stage={stage}")
    content = F.xxhash64(*[F.to_json(c) if isinstance(shape[c].dataType, MapType) else F.col(c) for c in shape.names])
    files = rows.groupBy(*LEVELS[1:], "_metadata.file_path").agg(
        F.max("_metadata.file_size").alias("size"), F.count(F.lit(1)).alias("rows"), F.sum(content.cast("decimal(38,0)")).alias("sum")
    )
    folders = files.groupBy(*LEVELS[1:]).agg(
        F.sum("size").cast("long").alias("size_byte"), F.sum("rows").alias("row_count"), F.sum("sum").alias("sum")
    )
    folder = record_levels(root, F.lit(stage), F.col("scope"), F.col("schedule"), F.col("task"))
    named = F.concat_ws(",", F.lit(stage), "scope", "schedule", "task", F.col("row_count").cast("string"), F.col("sum").cast("string"))
    return folders.select(
        ids.content_hash(named).alias("asset_id"),
        F.concat_ws("-", F.lit(stage), *LEVELS[1:]).alias("file_name"),
        folder.alias("file_path"),
        ids.mime_type(F.lit(kind)).alias("mime_type"),
        "size_byte",
        F.lit("SNAPPY" if kind == "parquet" else "NONE").alias("compression"),
        F.to_json(
            F.struct("size_byte", "row_count", F.struct(F.lit(kind).alias("extension"), "row_count").alias("custom_metadata"))
        ).alias("attributes"),
        created_at.alias("created_at"),
        created_at.alias("updated_at"),
        F.array("scope").alias("scope_ids"),
        F.array("schedule").alias("schedule_ids"),
        F.array("task").alias("task_ids"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(stage).alias("stage"),
    )


def etl(raw: DataFrame, task: str) -> DataFrame:
    return raw.withColumns({"embedding": F.lit(VECTOR_PLACEHOLDER), "stage": F.lit("2_ETL"), "task": F.lit(task)})


def analyse(rows: DataFrame, keys: list[str], bullish_from: float, has_price: Column | None = None) -> DataFrame:
    return insights.analysis(insights.average_price(rows, keys, has_price=has_price), bullish_from)


def display(rows: DataFrame, analyses: DataFrame, keys: list[str], created_at: Column) -> DataFrame:
    """Insight documents with lineage columns, ready to be searched."""
    points = insights.chart_points(rows, F.col("timestamp"), F.col("price"))
    points = points.withColumn("ticker", F.coalesce("ticker", F.lit("N/A")))
    grouped = [k for k in keys if k != "ticker"] + ["ticker"]
    cell = F.coalesce(F.substring("timestamp", 1, 13), F.lit(""))
    points = points.withColumn("timestamp", F.coalesce("timestamp", F.lit("")))
    series = insights.chart_series(points, grouped, ["timestamp", "id"], cell)
    documents = insights.dashboard_documents(series, analyses, keys)
    return documents.withColumns(
        {
            "scope_ids": F.array("scope"),
            "schedule_ids": F.array("schedule"),
            "tags": F.array("ticker"),
            "stage": F.lit("4_VISUALIZE"),
            "created_at": created_at,
        }
    )


def registered(spark: SparkSession, assets: DataFrame, root: str) -> DataFrame:
    """The catalog after the given rows are merged into it; only their folders are read and written."""
    upsert_catalog(assets, root)
    known = read_catalog(spark, root)
    return assets.limit(0) if known is None else known.drop("bucket")


def found_rows(spark: SparkSession, root: str, assets: str, stage: str, kind: str, shape: StructType, **ids_given: str) -> DataFrame:
    """The rows of all folders of a stage that the catalog finds, with ``file_path``.

    The hits are kept as a table of their own: later merges replace files of the catalog.
    """
    found = staged(catalog.search(read_catalog(spark, assets), {"extension": kind}, stage=stage, **ids_given), "hits")
    return read_catalogued(spark, found, f"{root}/stage={stage}", kind, shape, levels=LEVELS[1:])


def catalogued_stage(
    spark: SparkSession, root: str, assets: str, read: tuple[str, str, StructType], write: tuple[str, str],
    work: Callable[[DataFrame], DataFrame], created_at: Column, **ids_given: str,
) -> StructType:
    """One stage of a schedule around ``work``: its input is what a catalog search finds, its
    output is stored and merged into the catalog.

    ``read`` is (stage, kind, columns) and ``write`` (stage, kind). ``work`` gets the found rows
    and returns rows with ``stage, scope, schedule, task``. Returns the columns that were stored.
    """
    made = work(found_rows(spark, root, assets, *read, **ids_given).drop("file_path"))
    shape = made.drop(*LEVELS).schema
    save(made, root, write[1])
    registered(spark, folder_catalog(spark, root, *write, shape, created_at), assets)
    return shape


def run(spark: SparkSession, raw: DataFrame, root: str, created_at: Column, bullish_from: float = blocks.BULLISH_FROM) -> DataFrame:
    """Raw records to insight documents through the lake, each stage finding its input by
    a catalog search. ``raw`` has scope, schedule, task, stage and record columns.

    Below ``root``: the lake's stages 1 and 2, the analyses as catalogued records (stage 3), the
    catalog, and the insights, which are appended. Scope and schedule travel in the
    rows as scope_id and schedule_id, so any characters are right in them. Returns all insights.
    """
    lake, store, assets = f"{root}/lake", f"{root}/records", f"{root}/file_assets"
    keys = ["scope", "schedule"]
    own = {"scope_id": F.col("scope"), "schedule_id": F.col("schedule")}
    back = {"scope": F.col("scope_id"), "schedule": F.col("schedule_id")}

    kept = raw.withColumns(own)
    shape = kept.drop(*LEVELS).schema
    save(kept, lake, "json")
    registered(spark, folder_catalog(spark, lake, "1_RAW", "json", shape, created_at), assets)
    shape = catalogued_stage(
        spark, lake, assets, ("1_RAW", "json", shape), ("2_ETL", "parquet"), lambda rows: etl(rows.withColumns(back), "etl"), created_at
    )
    rows = found_rows(spark, lake, assets, "2_ETL", "parquet", shape).withColumns(back).drop("file_path")
    priced = F.lit("price" in rows.columns)
    lacking = {"price": "double", "timestamp": "string", "ticker": "string", "id": "string"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in lacking.items() if c not in rows.columns})

    result = analyse(rows, keys, bullish_from, priced)
    body = F.to_json(F.struct("scope", "schedule", "status", "sentiment", "average_price", "logic_used"))
    bodies = result.select(*keys, F.lit("analysis").alias("task"), body.alias("body"))
    saved = save_records(bodies, "body", store, "3_ANALYZE", "scope", "schedule", "task", [], created_at)
    found = catalog.search(registered(spark, saved, assets), {"extension": "json"}, stage="3_ANALYZE")
    shape = result.select(*keys, "status", "sentiment", "average_price", "logic_used").schema
    analyses = read_records(spark, store, found).select(F.from_json("body", shape).alias("a")).select("a.*")

    documents = display(rows, analyses, keys, created_at).withColumn("scope_id", F.col("scope"))
    append_insights(documents, f"{root}/insights")
    return spark.read.schema(documents.schema).json(f"{root}/insights")
