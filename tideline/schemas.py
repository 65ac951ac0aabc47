"""Row types of the lake, the catalog, the metadata graph and the tick stream."""

from __future__ import annotations

from pyspark.sql import types as T

# The four stages a stored object moves through, in order.
STAGES = ("1_RAW", "2_ETL", "3_ANALYZE", "4_VISUALIZE")

# Allowed entries of the enumerated metadata columns.
ALLOWED = {
    "schedule_mode": ("MANUAL", "AI_AGENT"),
    "scope_status": ("ACTIVE", "PAUSED"),
    "execution_type": ("CRON", "ONCE", "CONTINUOUS"),
    "restart_policy": ("ALWAYS", "ON_FAILURE", "NEVER"),
    "task_type": ("SEARCH", "ETL", "TRADITIONAL_LOGIC", "AI_INFERENCE", "VISUALIZE"),
    "engine_type": ("AIRFLOW_DAG", "STREAMING_WORKER"),
    "tool_language": ("Python", "Go", "C++"),
    "author_type": ("HUMAN", "AI_GENERATED"),
    "stage": STAGES,
}

_ids = T.ArrayType(T.StringType())

LINEAGE = [
    T.StructField("scope_ids", _ids),
    T.StructField("schedule_ids", _ids),
    T.StructField("tags", _ids),
    T.StructField("stage", T.StringType()),
]

RAW_RECORD = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("published_date", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

LAKE_ROW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("published_date", T.StringType()),
        T.StructField("scope_ids", _ids),
        T.StructField("schedule_ids", _ids),
    ]
)

KNOWLEDGE_EMBEDDING = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source_reference", T.StringType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("created_at", T.TimestampType()),
        *LINEAGE,
    ]
)

FILE_ASSET = T.StructType(
    [
        T.StructField("asset_id", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("size_byte", T.LongType()),
        T.StructField("compression", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("scope_ids", _ids),
        T.StructField("schedule_ids", _ids),
        T.StructField("task_ids", _ids),
        T.StructField("tags", _ids),
        T.StructField("stage", T.StringType()),
    ]
)

TICK = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("timestamp", T.DoubleType()),
    ]
)

CHART_POINT = T.StructType([T.StructField("time", T.StringType()), T.StructField("price", T.DoubleType())])

BLOCK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("colSpan", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("trend", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("subType", T.StringType()),
        T.StructField(
            "config",
            T.StructType(
                [
                    T.StructField("xAxisKey", T.StringType()),
                    T.StructField(
                        "lines",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("dataKey", T.StringType()),
                                    T.StructField("name", T.StringType()),
                                    T.StructField("color", T.StringType()),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
        T.StructField("data", T.ArrayType(CHART_POINT)),
    ]
)

INSIGHT = T.StructType(
    [
        T.StructField("scope_id", T.StringType()),
        T.StructField("schedule_id", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("insight_type", T.StringType()),
        T.StructField("blocks", T.ArrayType(BLOCK)),
        T.StructField("created_at", T.TimestampType()),
        *LINEAGE,
    ]
)
