"""Gathering of small files in a lake."""

import os

import pytest
from pyspark.sql import functions as F

from tideline.sinks import gathering

BY = ["dt", "ticker"]


def files(root):
    out = {}
    for folder, _, names in os.walk(root):
        data = sorted(n for n in names if n.endswith(".parquet"))
        if data:
            out[os.path.relpath(folder, root)] = data
    return out


@pytest.fixture()
def lake(spark, folder):
    root = f"{folder}/lake"
    rows = spark.range(400).select(
        "id", F.when(F.col("id") % 4 == 0, "01").otherwise("02").alias("dt"),
        F.when(F.col("id") % 3 == 0, "a b").when(F.col("id") % 3 == 1, None).otherwise("x=y").alias("ticker"),
    )
    # Ten batches, each with its own files; day 01 gets three of them only.
    for batch in range(10):
        part = rows.filter((F.col("id") % 10 == batch) & ((F.col("dt") == "02") | (F.col("id") % 10 < 5)))
        part.coalesce(1).write.mode("append").partitionBy(*BY).parquet(root)
    return root


def content(spark, root):
    return sorted(tuple(r) for r in gathering.as_folders(spark, root, BY).select("id", "dt", F.coalesce("ticker", F.lit("-"))).collect())


def test_only_crowded_partitions_are_rewritten(spark, lake):
    before, rows = files(lake), content(spark, lake)
    done = gathering.gather(spark, lake, BY, least_files=8, per_round=2)
    after = files(lake)
    crowded = {k for k, names in before.items() if len(names) >= 8}
    assert crowded and crowded != set(before) and len(done) == len(crowded)
    assert set(after) == set(before)
    for partition, names in before.items():
        if partition in crowded:
            assert len(after[partition]) <= 2 and not set(names) & set(after[partition])
        else:
            assert after[partition] == names, "other partitions stay as they are"
    assert content(spark, lake) == rows
    assert gathering.gather(spark, lake, BY, least_files=8) == [], "nothing is left to gather"


def test_large_files_are_left(spark, lake):
    before = files(lake)
    assert gathering.gather(spark, lake, BY, least_files=8, small_bytes=10) == []
    assert files(lake) == before


def test_listing_counts_bytes(spark, lake):
    found = {(r.dt, r.ticker): r for r in gathering.partition_files(spark, lake, BY, 1 << 20).collect()}
    assert sum(r.files for r in found.values()) == sum(map(len, files(lake).values()))
    assert all(r.small_files == r.files and r.bytes > 0 for r in found.values())


def test_a_stream_sinks_folder_is_refused(spark, folder):
    os.makedirs(f"{folder}/s/_spark_metadata")
    with pytest.raises(ValueError):
        gathering.gather(spark, f"{folder}/s", BY)
