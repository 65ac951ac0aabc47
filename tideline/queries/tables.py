"""The given tables, read as the entities the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.schemas import STAGES
from tideline.sources.records import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is heavy per text."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as price ticks: the event type plays the ticker."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("ticker"), F.col("value").alias("price"), "user_id"
    )


def stage_of(n_chars: str = "n_chars") -> Column:
    """Stage of a document, told by its length."""
    return (
        F.when(F.col(n_chars) < 500, STAGES[0])
        .when(F.col(n_chars) < 1500, STAGES[1])
        .when(F.col(n_chars) < 3000, STAGES[2])
        .otherwise(STAGES[3])
    )


# The same stage rule in SQL.
STAGE_SQL = (
    "CASE WHEN n_chars < 500 THEN '1_RAW' WHEN n_chars < 1500 THEN '2_ETL' "
    "WHEN n_chars < 3000 THEN '3_ANALYZE' ELSE '4_VISUALIZE' END"
)


def stamped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with lineage columns: scope is the source, schedule and tag the language."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        "lang",
        "source",
        "n_chars",
        F.array("source").alias("scope_ids"),
        F.array(F.concat(F.lit("sch-"), "lang")).alias("schedule_ids"),
        F.array("lang", F.concat_ws("-", "lang", "source")).alias("tags"),
        stage_of().alias("stage"),
    )


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as schedules: urgent ones run by cron, the scope is the customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("schedule_id"),
        F.col("o_custkey").alias("scope_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "CRON")
        .when(F.col("o_orderpriority") == "2-HIGH", "CONTINUOUS")
        .otherwise("ONCE")
        .alias("execution_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "0 8 * * *").alias("cron_expression"),
        F.col("o_orderdate").alias("created_at"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tasks, one per (order, line number); the part is the tool.

    A task depends on the line before it, which may not exist.
    """
    task_types = F.array(*[F.lit(t) for t in ("SEARCH", "ETL", "TRADITIONAL_LOGIC", "AI_INFERENCE", "VISUALIZE")])
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_partkey").alias("tool_id"))
        .select(
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("task_id"),
            F.col("l_orderkey").alias("schedule_id"),
            F.element_at(task_types, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("task_type"),
            "tool_id",
            F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") * 100 + F.col("l_linenumber") - 1).alias(
                "depends_on_task_id"
            ),
            F.col("l_linenumber").alias("execution_order"),
        )
    )


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tools: the brand's file type goes in, the part type's file type comes out."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("tool_id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("s3a://tool-scripts/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey"), F.lit(".py")).alias(
            "script_url"
        ),
        F.when(F.col("p_size") <= 25, F.to_json(F.struct(F.lower("p_type").alias("expected_file_type")))).alias(
            "input_schema"
        ),
        F.when(F.col("p_size") >= 10, F.to_json(F.struct(F.lower("p_type").alias("file_type")))).alias("output_schema"),
    )


TASKS_SQL = (
    "SELECT l_orderkey*100+l_linenumber AS task_id, l_orderkey AS schedule_id, "
    "(['SEARCH','ETL','TRADITIONAL_LOGIC','AI_INFERENCE','VISUALIZE'])[l_linenumber % 5 + 1] AS task_type, "
    "min(l_partkey) AS tool_id, "
    "CASE WHEN l_linenumber > 1 THEN l_orderkey*100+l_linenumber-1 END AS depends_on_task_id, "
    "l_linenumber AS execution_order FROM lineitem GROUP BY l_orderkey, l_linenumber"
)

SCHEDULES_SQL = (
    "SELECT o_orderkey AS schedule_id, o_custkey AS scope_id, "
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRON' WHEN '2-HIGH' THEN 'CONTINUOUS' ELSE 'ONCE' END AS execution_type, "
    "CASE WHEN o_orderpriority = '1-URGENT' THEN '0 8 * * *' END AS cron_expression, o_orderdate AS created_at FROM orders"
)

TOOLS_SQL = (
    "SELECT p_partkey AS tool_id, p_name AS name, "
    "'s3a://tool-scripts/' || lower(p_type) || '/' || p_partkey || '.py' AS script_url, "
    "CASE WHEN p_size <= 25 THEN lower(p_type) END AS expected_file_type, "
    "CASE WHEN p_size >= 10 THEN lower(p_type) END AS file_type FROM part"
)
