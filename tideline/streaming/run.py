"""Starting and finishing streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None) -> DataStreamWriter:
    """Hand every micro-batch to ``handle(df, batch_id)``. A batch repeated after a failure
    has the same id, so handlers write to places named by it."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.queryName(name) if name else writer


def to_files(
    stream: DataFrame, path: str, checkpoint: str, by: list[str] | None = None, kind: str = "parquet"
) -> DataStreamWriter:
    writer = stream.writeStream.format(kind).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy(*by) if by else writer


def finish(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything that is there now, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def batches_written(spark: SparkSession, root: str, schema) -> DataFrame:
    """All per-batch outputs below a root; no rows when no batch wrote any."""
    from tideline.sources.records import or_empty

    return or_empty(spark, lambda: spark.read.schema(schema).parquet(f"{root}/batch=*"), schema)


def committed(handle: Callable[[DataFrame, int], None], root: str) -> Callable[[DataFrame, int], None]:
    """``handle`` with a mark below ``root`` that its batch is whole, written after all its sinks.

    Readers that go by the marks (``committed_rows``) never see a batch that failed between two
    sinks; when it is repeated its outputs are written anew and then marked.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        handle(batch, batch_id)
        done = batch.sparkSession.createDataFrame([(True,)], "done boolean")
        done.coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/batch={batch_id}")

    return run


def _by_batch(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    from tideline.sources.records import or_empty

    numbered = StructType([*schema.fields, StructField("batch", LongType())])
    return or_empty(spark, lambda: spark.read.schema(numbered).parquet(path), numbered)


def _marks(spark: SparkSession, root: str) -> DataFrame:
    return _by_batch(spark, f"{root}/commits", StructType.fromDDL("done boolean")).select("batch")


def committed_rows(spark: SparkSession, root: str, sink: str, schema: StructType) -> DataFrame:
    """The rows of one sink below ``root``, of committed batches only, with the batch number."""
    return _by_batch(spark, f"{root}/{sink}", schema).join(_marks(spark, root), "batch", "left_semi")


def changes_handler(root: str) -> Callable[[DataFrame, int], None]:
    """The rows that a batch in update mode changed, under its number: what is written grows with
    the keys that changed, not with all there are. ``latest_changes`` reads the newest of each."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")

    return committed(handle, root)


def latest_changes(spark: SparkSession, root: str, keys: list[str], schema: StructType) -> DataFrame:
    """The newest committed row of each key: from the newest base and the changes after it."""
    from tideline.operators.insights import newest
    from tideline.sinks.lake import latest_version, snapshot

    rows, base = committed_rows(spark, root, "changes", schema), latest_version(spark, f"{root}/base")
    if base is not None:
        before = snapshot(spark, f"{root}/base", base).withColumn("batch", F.lit(base).cast("long"))
        rows = rows.filter(F.col("batch") > base).unionByName(before)
    return newest(rows, keys, ["batch"]).select(*schema.names)


def compact_changes(spark: SparkSession, root: str, keys: list[str], schema: StructType) -> int | None:
    """Gather all committed changes into a new base, numbered by the last batch in it. Readers then
    skip the batches before; without a committed batch nothing happens."""
    from tideline.sinks.lake import publish_snapshot

    last = _marks(spark, root).agg(F.max("batch")).first()[0]
    if last is not None:
        publish_snapshot(latest_changes(spark, root, keys, schema), f"{root}/base", last)
    return last


def dropped_late(query: StreamingQuery) -> int:
    """Rows that a query's operators dropped as later than the watermark, over its recent batches."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
