"""Properties of physical plans that decide whether a query survives large data."""

import re

import pytest

from tests.conftest import SMALL
from tideline.queries import REGISTERED

QUERIES = {name: item.build for name, item in REGISTERED.items()}
STREAMED = {name for name in QUERIES if name.startswith("stream_")} | {"watchdog_triggers", "staged_insights", "etl_run"}


def plan(frame) -> str:
    return re.sub(r"#\d+L?", "", frame._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMED))
def test_no_pairs_no_row_udfs_no_shrinking_frames(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for part in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert part not in text, part
    # A frame over the whole cell is one pass; one from the row to the end is not.
    assert not re.search(r"windowframe\(\w+, (?!unboundedpreceding)[^,]+, unboundedfollowing", text)


def test_candles_stay_hash_based_and_read_only_their_columns(spark):
    text = plan(QUERIES["ohlcv_5m"](spark, SMALL))
    assert "HashAggregate" in text and "SortAggregate" not in text
    assert "props" not in text and text.count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["trigger_requests"](spark, SMALL))
    assert "DataFilters: [isnotnull(value), NOT isnan(value), (value >= 200.0)" in text and "props" not in text


def test_partition_folders_are_skipped(spark, folder):
    from pyspark.sql import functions as F

    from tideline.sources.records import read_partitioned

    spark.range(40).withColumn("scope", F.col("id") % 4).write.partitionBy("scope").parquet(f"{folder}/t")
    text = read_partitioned(spark, f"{folder}/t").filter("scope = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scope" in text


def test_ticks_are_shuffled_once_for_breakouts(spark):
    frame = QUERIES["breakout_history"](spark, SMALL)
    frame.collect()
    final = plan(frame).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


@pytest.mark.parametrize(
    "name, most",
    [(n, 1) for n in ("moving_average", "rsi", "macd", "volume_spike", "level_break", "reversal")]
    + [(n, 2) for n in ("dashboard_blocks", "asof_context", "drop_1h")],
)
def test_events_are_scanned_and_aggregated_once(spark, name, most):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = QUERIES[name](spark, SMALL)
        frame.collect()
        final = plan(frame).split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert final.count("FileScan parquet") <= most


@pytest.mark.parametrize("name, most", [("drop_1h", 2), ("macd", 1), ("moving_average", 1), ("asof_context", 2)])
def test_scans_of_a_larger_table_under_usual_settings(spark, name, most):
    frame = QUERIES[name](spark, "/root/testdata/sf0.1")
    frame.collect()
    assert plan(frame).split("== Initial Plan ==")[0].count("FileScan parquet") <= most


def test_archive_returns_all_partitions_and_one_is_pruned(spark):
    whole, events = QUERIES["stream_archive_all"](spark, SMALL), spark.read.parquet(f"{SMALL}/events.parquet")
    assert {tuple(r) for r in whole.groupBy("ticker").count().collect()} == {tuple(r) for r in events.groupBy("event_type").count().collect()}
    text = plan(QUERIES["stream_archive"](spark, SMALL))
    assert "(ticker = purchase)" in text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
