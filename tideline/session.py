"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# State in RocksDB, which keyed state with lists and timers needs; a batch checkpoints its changes only.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def shuffle_partitions(input_bytes: int) -> int:
    """Shuffle partitions to start from for an input of the given size.

    About half a gigabyte each, which spills little on usual executors; AQE merges the ones
    that turn out small. The upper bound keeps the shuffle's block count manageable.
    """
    return max(200, min(100_000, input_bytes // (512 << 20)))


def build_session(
    app: str = "tideline", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings every job here relies on.

    Nothing sized to one machine is set unless the master is local. On a cluster give
    ``input_bytes``, roughly, so that shuffles start with enough partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    for key, value in STATE_STORE.items():
        builder = builder.config(key, value)
    if master is not None:
        builder = builder.master(master)
    if input_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes)))
    elif master is not None and master.startswith("local"):
        builder = builder.config("spark.sql.shuffle.partitions", "8")
    if master is not None and master.startswith("local"):
        builder = (
            builder.config("spark.ui.enabled", "false")
            .config("spark.driver.memory", os.environ.get("TIDELINE_DRIVER_MEMORY", "8g"))
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def with_state_store(spark: SparkSession) -> None:
    """The state store's settings for streams that start from now on, whoever made the session."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new path for intermediate tables, under the folder the cluster shares.

    ``spark.checkpoint.dir`` names that folder. Only a local session may fall back to the
    machine's own temporary folder; on a cluster executors could not read it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="tideline-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table of their own in the shared scratch folder."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
