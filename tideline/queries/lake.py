"""Lineage and catalog searches, merges and deletes over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import ids, text
from tideline.operators import catalog, lineage
from tideline.operators.metadata import listing
from tideline.queries.registry import query
from tideline.session import scratch_dir
from tideline.sinks.catalog_store import lineage_by_bridge, read_catalog, upsert_catalog, write_bridge
from tideline.sinks.gathering import as_folders, gather, partition_files
from tideline.queries.tables import STAGE_SQL, documents, stage_of, stamped_documents, table


def document_assets(spark, sf_dir, day="2024-01-01", scope="source"):
    docs = documents(spark, sf_dir).select(
        "text",
        F.col(scope).alias("scope"),
        F.concat(F.lit("sch-"), "lang").alias("schedule"),
        F.concat_ws("-", F.lit("task"), "source", "lang").alias("task"),
        F.array("lang", "source").alias("tags"),
        stage_of().alias("stage"),
        F.lit(day).cast("timestamp").alias("created_at"),
    )
    return catalog.text_assets(docs, "text", "scope", "schedule", "task")


# The supplied texts hold no line break but \n and no blank but the plain one.
LINES_SQL = "len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END"
WORDS_SQL = r"len(regexp_extract_all(text, '\S+'))"
ASSETS_SQL = f"""SELECT sha256(text) AS asset_id, sha256(text) || '.txt' AS file_name,
    's3a://processed-data/' || ({STAGE_SQL}) || '/' || source || '/sch-' || lang || '/task-' || source || '-' || lang || '/' || sha256(text) || '.txt' AS file_path,
    strlen(text) AS size_byte, ({LINES_SQL}) AS line_count, ({WORDS_SQL}) AS word_count,
    source, lang, ({STAGE_SQL}) AS stage FROM documents"""


@query(
    "lineage_search",
    f"""SELECT doc_id, stage, source, lang FROM (SELECT *, {STAGE_SQL} AS stage FROM documents)
        WHERE stage = '2_ETL' AND ((source IN ('src1', 'src7', 'src12') AND lang IN ('en', 'de')) OR lang IN ('fr'))
        ORDER BY n_chars DESC, doc_id LIMIT 50""",
)
def lineage_search(spark, sf_dir):
    found = catalog.lineage_search(
        stamped_documents(spark, sf_dir), "2_ETL", ["src1", "src7", "src12"], ["sch-en", "sch-de"], ["fr"],
        newest_by=[F.desc("n_chars"), F.asc("doc_id")], limit=50,
    )
    return found.select("doc_id", "stage", "source", "lang")


@query(
    "lineage_count",
    f"""SELECT stage, source, count(*) AS n FROM (SELECT *, {STAGE_SQL} AS stage FROM documents)
        WHERE stage = '3_ANALYZE' AND (lang IN ('en', 'de') OR lang || '-' || source IN ('fr-src3', 'es-src4')) GROUP BY ALL""",
)
def lineage_count(spark, sf_dir):
    found = catalog.lineage_search(
        stamped_documents(spark, sf_dir), "3_ANALYZE", schedule_ids=["sch-en", "sch-de"], tags=["fr-src3", "es-src4"]
    )
    return found.groupBy("stage", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "catalog_search",
    f"""SELECT asset_id, file_path, 'text/plain' AS mime_type, size_byte FROM ({ASSETS_SQL})
        WHERE stage = '2_ETL' AND lang = 'en' AND line_count = 7""",
)
def catalog_search(spark, sf_dir):
    expected = {"extension": "txt", "hash_algorithm": "SHA-256", "line_count": 7, "encoding": "utf-8"}
    found = catalog.search(document_assets(spark, sf_dir), expected, stage="2_ETL", schedule_id="sch-en")
    size = F.get_json_object("attributes", "$.size_byte").cast("long")
    return found.select("asset_id", "file_path", "mime_type", size.alias("size_byte"))


@query(
    "catalog_upsert",
    f"""WITH b AS (SELECT *, 0 AS batch, source AS scope FROM ({ASSETS_SQL}) UNION ALL
                   SELECT *, 1 AS batch, 'scope-' || lang AS scope FROM ({ASSETS_SQL})),
        p AS (SELECT *, replace(file_path, '/' || source || '/sch-', '/' || scope || '/sch-') AS saved_path FROM b)
        SELECT asset_id, arg_min(saved_path, (batch, file_name, saved_path)) AS file_path, any_value(size_byte) AS size_byte,
        CASE WHEN max(batch) = 1 THEN '2024-01-02' ELSE '2024-01-01' END AS updated_on,
        array_to_string(list_sort(list_distinct(list(scope))), ',') AS scope_ids,
        array_to_string(list_sort(list_distinct(flatten(list([lang, source])))), ',') AS tags FROM p GROUP BY asset_id""",
)
def catalog_upsert(spark, sf_dir):
    docs_by_lang = documents(spark, sf_dir).withColumn("scope", F.concat(F.lit("scope-"), "lang"))
    again = catalog.text_assets(
        docs_by_lang.select(
            "text", "scope", F.concat(F.lit("sch-"), "lang").alias("schedule"),
            F.concat_ws("-", F.lit("task"), "source", "lang").alias("task"),
            F.array("lang", "source").alias("tags"), stage_of().alias("stage"),
            F.lit("2024-01-02").cast("timestamp").alias("created_at"),
        ),
        "text", "scope", "schedule", "task",
    )
    return _shown_assets(catalog.upsert(document_assets(spark, sf_dir), again))


def _shown_assets(assets):
    return assets.select(
        "asset_id", "file_path", "size_byte",
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"),
        F.array_join("scope_ids", ",").alias("scope_ids"), F.array_join("tags", ",").alias("tags"),
    )


@query(
    "catalog_incremental",
    f"""WITH b AS (SELECT *, 0 AS batch, source AS scope FROM ({ASSETS_SQL}) UNION ALL
                   SELECT *, 1 AS batch, 'scope-' || lang AS scope FROM ({ASSETS_SQL}) WHERE lang = 'de' AND source LIKE 'src1%'),
        p AS (SELECT *, replace(file_path, '/' || source || '/sch-', '/' || scope || '/sch-') AS saved_path FROM b)
        SELECT asset_id, arg_min(saved_path, (batch, file_name, saved_path)) AS file_path, any_value(size_byte) AS size_byte,
        CASE WHEN max(batch) = 1 THEN '2024-01-02' ELSE '2024-01-01' END AS updated_on,
        array_to_string(list_sort(list_distinct(list(scope))), ',') AS scope_ids,
        array_to_string(list_sort(list_distinct(flatten(list([lang, source])))), ',') AS tags FROM p GROUP BY asset_id""",
)
def catalog_incremental(spark, sf_dir):
    # The catalog on disk: all assets, then some of them once more from another scope.
    root = f"{scratch_dir(spark, 'catalog')}/file_assets"
    upsert_catalog(document_assets(spark, sf_dir), root)
    some = documents(spark, sf_dir).filter((F.col("lang") == "de") & F.startswith("source", F.lit("src1"))).select(
        "text", F.concat(F.lit("scope-"), "lang").alias("scope"), F.concat(F.lit("sch-"), "lang").alias("schedule"),
        F.concat_ws("-", F.lit("task"), "source", "lang").alias("task"), F.array("lang", "source").alias("tags"),
        stage_of().alias("stage"), F.lit("2024-01-02").cast("timestamp").alias("created_at"),
    )
    upsert_catalog(catalog.text_assets(some, "text", "scope", "schedule", "task"), root)
    return _shown_assets(read_catalog(spark, root))


@query(
    "bridge_search",
    f"""SELECT doc_id, stage, source, lang FROM (SELECT *, {STAGE_SQL} AS stage FROM documents)
        WHERE stage = '2_ETL' AND ((source IN ('src1', 'src7', 'src12') AND lang IN ('en', 'de')) OR lang || '-' || source IN ('fr-src3'))""",
)
def bridge_search(spark, sf_dir):
    # Documents are assets by their number; ids lead to them over the bridge.
    root = scratch_dir(spark, "bridge")
    assets = stamped_documents(spark, sf_dir).drop("text").withColumn("asset_id", F.col("doc_id").cast("string"))
    write_bridge(assets, root)
    found = lineage_by_bridge(spark.read.parquet(root), assets, "2_ETL", ["src1", "src7", "src12"], ["sch-en", "sch-de"], ["fr-src3"])
    return found.select("doc_id", "stage", "source", "lang")


@query(
    "catalog_delete",
    f"SELECT asset_id, file_path FROM ({ASSETS_SQL}) WHERE NOT starts_with(file_path, 's3a://processed-data/1_RAW/src1/')",
)
def catalog_delete(spark, sf_dir):
    left = catalog.delete(document_assets(spark, sf_dir), catalog.delete_prefix("1_RAW", "src1"))
    return left.select("asset_id", "file_path")


@query(
    "asset_lookup",
    f"""WITH a AS ({ASSETS_SQL}) SELECT DISTINCT file_path, file_name, 'text/plain' AS mime_type FROM a
        WHERE asset_id = (SELECT max(asset_id) FROM a)""",
)
def asset_lookup(spark, sf_dir):
    assets = document_assets(spark, sf_dir)
    wanted = assets.agg(F.max("asset_id").alias("asset_id")).first()["asset_id"]
    return catalog.lookup(assets, wanted).distinct()


@query(
    "text_stats",
    f"""SELECT doc_id, strlen(text) AS size_byte, sha256(text) AS asset_id, ({LINES_SQL}) AS line_count,
        ({WORDS_SQL}) AS word_count, 'text/plain' AS mime_type FROM documents""",
)
def text_stats(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("size_byte"),
        ids.content_hash("text").alias("asset_id"),
        text.line_count("text").cast("long").alias("line_count"),
        text.word_count("text").cast("long").alias("word_count"),
        ids.mime_type(F.lit(".TXT")).alias("mime_type"),
    )


@query(
    "name_search",
    "SELECT p_partkey AS tool_id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name, p_partkey",
)
def name_search(spark, sf_dir):
    tools = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tool_id"), F.col("p_name").alias("name"))
    return listing(tools, ["tool_id", "name"], ["name", "tool_id"], lineage.name_contains("name", "RING"))


@query(
    "catalog_listing",
    f"""SELECT stage, source, count(*) AS n, sum(size_byte)::BIGINT AS size_byte FROM ({ASSETS_SQL}) GROUP BY ALL""",
)
def catalog_listing(spark, sf_dir):
    assets = document_assets(spark, sf_dir).withColumn("source", F.element_at("scope_ids", 1))
    counted = assets.groupBy("stage", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size_byte").alias("size_byte"))
    return listing(counted, ["stage", "source", "n", "size_byte"], ["stage", F.col("source").asc_nulls_last()])


@query(
    "gathered_lake",
    """SELECT strftime(ts, '%Y-%m') AS month, event_type AS ticker, count(*) AS n, CAST(sum(CAST("value" AS DECIMAL(28,10))) AS DOUBLE) AS total, TRUE AS gathered
        FROM events GROUP BY 1, 2""",
)
def gathered_lake(spark, sf_dir):
    # Six appends leave six files and more per month and ticker; then the crowded partitions are gathered.
    root, by = scratch_dir(spark, "small-files"), ["month", "ticker"]
    rows = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_type").alias("ticker"), F.col("event_id").alias("id"), F.col("value").alias("price")
    )
    for batch in range(6):
        rows.filter(F.pmod("id", F.lit(6)) == batch).write.mode("append").partitionBy(*by).parquet(root)
    gather(spark, root, by, least_files=4)
    held = as_folders(spark, root, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(28,10)")).cast("double").alias("total")
    )
    files = partition_files(spark, root, by, 64 << 20).select(*by, (F.col("small_files") < 4).alias("gathered"))
    return held.join(files, by)
