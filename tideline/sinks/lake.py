"""Partitioned lake writes, content-addressed records, snapshots and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.functions import ids
from tideline.operators.ordered import join_on
from tideline.session import scratch_dir
from tideline.sources.records import or_empty


def partition_path(root: str, scope_id: str, schedule_id: str) -> str:
    return f"{root}/scope={ids.folder_text(scope_id)}/schedule={ids.folder_text(schedule_id)}"


def write_partition(df: DataFrame, root: str, scope_id: str, schedule_id: str) -> None:
    """Replace one scope and schedule of a Parquet lake; all others stay.

    The folder itself is written, so that no rows replace the old ones too."""
    df.write.mode("overwrite").parquet(partition_path(root, scope_id, schedule_id))


def write_partitions(df: DataFrame, root: str, by: list[str], kind: str = "parquet", even: bool = True) -> None:
    """Replace the partitions that ``df`` has rows for.

    ``even`` lets AQE gather small partitions into one file and split a hot one over many.
    """
    rows = df.hint("rebalance", *by) if even else df
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.format(kind).save(root)


def record_levels(root: str, stage: Column, scope: Column, schedule: Column, task: Column) -> Column:
    """The folder that holds the records of a stage, scope, schedule and task."""
    parts = (("stage", stage), ("scope", scope), ("schedule", schedule), ("task", task))
    return F.concat_ws("/", F.lit(root), *[F.concat(F.lit(f"{name}="), ids.folder_name(value)) for name, value in parts])


def save_records(
    df: DataFrame, body_json: str, root: str, stage: str, scope: str, schedule: str, task: str, tags: list[str], created_at: Column
) -> DataFrame:
    """Add records to the store under their content address and give their catalog rows.

    Records of one scope, schedule and task share files, and the catalog's ``file_path`` names
    their folder; ``read_records`` finds a record there by its asset id. A file per record would
    be millions of small files. What is stored already is not stored again, so saving twice, or
    a repeated attempt, changes nothing, and other records stay. The bytes are made once: the
    catalog rows come from the same staged table as the files.
    """
    spark = df.sparkSession
    staged = scratch_dir(spark, "records")
    body = df.select(F.col(scope).alias("scope"), F.col(schedule).alias("schedule"), F.col(task).alias("task"), F.col(body_json).alias("__json"))
    body = body.withColumn("body", ids.canonical_json(F.col("__json"))).drop("__json")
    hashed = body.withColumn("asset_id", ids.content_hash("body"))
    hashed.write.parquet(staged)
    rows = spark.read.schema(hashed.schema).parquet(staged)

    new = rows.dropDuplicates(["scope", "schedule", "task", "asset_id"]).withColumn("stage", F.lit(stage))
    levels = ["stage", "scope", "schedule", "task"]
    shape = new.select("body", "asset_id", *levels).schema
    known = or_empty(spark, lambda: spark.read.schema(shape).parquet(root), shape).filter(F.col("stage") == stage)
    new = join_on(new, known.select(*levels, "asset_id"), [*levels, "asset_id"], "left_anti").select("body", "asset_id", *levels)
    new.hint("rebalance", *levels).write.mode("append").partitionBy(*levels).parquet(root)
    return rows.select(
        "asset_id",
        F.concat("asset_id", F.lit(".json")).alias("file_name"),
        record_levels(root, F.lit(stage), F.col("scope"), F.col("schedule"), F.col("task")).alias("file_path"),
        ids.mime_type(F.lit("json")).alias("mime_type"),
        F.octet_length("body").cast("long").alias("size_byte"),
        F.lit("NONE").alias("compression"),
        F.to_json(
            F.struct(
                F.octet_length("body").cast("long").alias("size_byte"),
                F.lit("SHA-256").alias("hash_algorithm"),
                F.struct(F.lit("json").alias("extension")).alias("custom_metadata"),
            )
        ).alias("attributes"),
        created_at.alias("created_at"),
        created_at.alias("updated_at"),
        F.array("scope").alias("scope_ids"),
        F.array("schedule").alias("schedule_ids"),
        F.array("task").alias("task_ids"),
        ids.literal_array(tags).alias("tags"),
        F.lit(stage).alias("stage"),
    )


def read_records(spark: SparkSession, root: str, hits: DataFrame) -> DataFrame:
    """(asset_id, body, stage, scope, schedule, task) of the records a catalog search found.

    ``hits`` has asset_id and file_path. The store is partitioned by the levels in the path, so
    Spark reads only folders that hits name."""
    shape = StructType.fromDDL("body string, asset_id string, stage string, scope string, schedule string, task string")
    stored = or_empty(spark, lambda: spark.read.schema(shape).parquet(root), shape)
    folder = record_levels(root, F.col("stage"), F.col("scope"), F.col("schedule"), F.col("task"))
    wanted = hits.select(F.col("asset_id"), F.col("file_path").alias("__folder")).distinct()
    return stored.withColumn("__folder", folder).join(wanted, ["asset_id", "__folder"], "left_semi").drop("__folder")


def delete_records(
    spark: SparkSession, assets: DataFrame, root: str, stage: str, scope: str | None = None, schedule: str | None = None,
    task: str | None = None, asset_id: str | None = None,
) -> tuple[DataFrame, int]:
    """Remove the stored records below a level, or one of them, with their catalog rows.

    A level needs all levels above it. Whole folders are removed by the file system; a single
    record's folder is written anew without it. Returns the catalog rows left and how many went.
    """
    levels = {"stage": stage, "scope": scope, "schedule": schedule, "task": task}
    given = [x is not None for x in (*levels.values(), asset_id)]
    if given != sorted(given, reverse=True):
        raise ValueError("a lower level needs the upper ones")
    folder = "/".join([root, *[f"{name}={ids.folder_text(value)}" for name, value in levels.items() if value is not None]])
    gone = (F.col("file_path") == folder) | F.startswith(F.col("file_path"), F.lit(f"{folder}/"))
    if asset_id is not None:
        gone = gone & (F.col("asset_id") == asset_id)
    gone = F.coalesce(gone, F.lit(False))
    count = assets.filter(gone).count()
    if asset_id is None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    else:
        shape = StructType.fromDDL("body string, asset_id string")
        kept = scratch_dir(spark, "kept")
        or_empty(spark, lambda: spark.read.schema(shape).parquet(folder), shape).filter(F.col("asset_id") != asset_id).write.parquet(kept)
        spark.read.schema(shape).parquet(kept).write.mode("overwrite").parquet(folder)
    return assets.filter(~gone), count


def publish_snapshot(df: DataFrame, root: str, version: int, by: list[str] | None = None, keep: int | None = None) -> str:
    """Write a whole new state beside the old ones. The same version is written anew, so a
    repeated attempt does no harm. With ``keep`` only so many versions stay."""
    path = f"{root}/version={version:012d}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    if keep is not None and version >= keep:
        jvm = df.sparkSession.sparkContext._jvm
        old = jvm.org.apache.hadoop.fs.Path(f"{root}/version={version - keep:012d}")
        old.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return path


def snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version:012d}")


def latest_version(spark: SparkSession, root: str) -> int | None:
    """Highest completely written version under a root; None when there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    versions = []
    for status in system.listStatus(folder):
        path = status.getPath()
        if path.getName().startswith("version=") and system.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            versions.append(int(path.getName().split("=")[1]))
    return max(versions, default=None)


def append_insights(documents: DataFrame, path: str) -> None:
    documents.write.mode("append").partitionBy("scope_id").json(path)


def export_schedules(nested: DataFrame, path: str) -> None:
    """One JSON object per line and schedule part, replacing the export before."""
    nested.select(F.to_json(F.struct(*nested.columns)).alias("value")).write.mode("overwrite").text(path)
