import json

import pytest
from pyspark.sql import functions as F

from tideline.operators import catalog, lineage

ROWS = [
    (1, "2_ETL", ["a"], ["s1"], ["x"]),
    (2, "2_ETL", ["a"], ["s2"], []),
    (3, "2_ETL", ["b"], ["s1"], None),
    (4, "2_ETL", None, None, ["x", None]),
    (5, "1_RAW", ["a"], ["s1"], ["x"]),
    (6, "2_ETL", ["a", None], [], ["y"]),
]
SHAPE = "id int, stage string, scope_ids array<string>, schedule_ids array<string>, tags array<string>"


def found(spark, **wanted):
    rows = spark.createDataFrame(ROWS, SHAPE)
    return sorted(r.id for r in rows.filter(lineage.lineage_match("2_ETL", **wanted)).collect())


def test_empty_lists_drop_their_term(spark):
    assert found(spark) == [1, 2, 3, 4, 6]
    assert found(spark, scope_ids=["a"]) == [1, 2, 6]
    assert found(spark, scope_ids=["a"], schedule_ids=["s1"]) == [1]
    assert found(spark, tags=["x"]) == [1, 4]
    assert found(spark, scope_ids=["b"], schedule_ids=["s1"], tags=["y"]) == [3, 6]


def test_no_match_is_false_not_null(spark):
    rows = spark.createDataFrame(ROWS, SHAPE)
    flags = rows.select(lineage.lineage_match("2_ETL", scope_ids=["zzz"]).alias("m")).collect()
    assert {r.m for r in flags} == {False}


ATTRIBUTES = [
    ("both", {"kind": "outer", "custom_metadata": {"kind": "inner"}}),
    ("outer", {"kind": "outer", "custom_metadata": {}}),
    ("number", {"n": 1, "custom_metadata": {}}),
    ("text", {"n": "1", "custom_metadata": {}}),
    ("fraction", {"n": 1.0, "custom_metadata": {}}),
    ("flag", {"n": True, "custom_metadata": {}}),
    ("null", {"n": None, "custom_metadata": {}}),
    ("list", {"custom_metadata": {"columns": ["a", "b"]}}),
    ("odd", {"custom_metadata": {"a'b.c": "x"}}),
    ("big", {"n": 9007199254740993}),
]


def matching(spark, expected):
    rows = [(k, json.dumps(v)) for k, v in ATTRIBUTES] + [("bad", "{"), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, attributes string")
    return sorted(r.k for r in frame.filter(lineage.metadata_match("attributes", expected)).collect())


def test_metadata_match_is_exact_in_value_and_kind(spark):
    assert matching(spark, {"kind": "outer"}) == ["outer"]
    assert matching(spark, {"kind": "inner"}) == ["both"]
    assert matching(spark, {"n": 1}) == ["fraction", "number"]
    assert matching(spark, {"n": 1.0}) == ["fraction", "number"]
    assert matching(spark, {"n": "1"}) == ["text"]
    assert matching(spark, {"n": True}) == ["flag"]
    assert matching(spark, {"n": None}) == ["null"]
    assert matching(spark, {"columns": ["a", "b"]}) == ["list"]
    assert matching(spark, {"columns": ["b", "a"]}) == []
    assert matching(spark, {"a'b.c": "x"}) == ["odd"]
    assert matching(spark, {"n": 9007199254740993}) == ["big"]
    assert matching(spark, {"n": 9007199254740992}) == []
    assert matching(spark, {"absent": 1}) == []
    assert "bad" not in matching(spark, {})


def assets(spark, rows):
    """(text, scope, tags, day) to catalog rows."""
    frame = spark.createDataFrame(rows, "text string, scope string, tags array<string>, day string").select(
        "text", "scope", "tags", F.lit("sch").alias("schedule"), F.lit("t1").alias("task"), F.lit("2_ETL").alias("stage"),
        F.to_timestamp("day").alias("created_at"),
    )
    return catalog.text_assets(frame, "text", "scope", "schedule", "task")


def test_upsert_unites_and_keeps_the_first(spark):
    old = assets(spark, [("same", "s1", ["a"], "2024-01-01"), ("only old", "s1", [], "2024-01-01")])
    new = assets(spark, [("same", "s2", ["b", "a"], "2024-01-02"), ("same", "s3", None, "2024-01-03"), ("only new", "s2", ["c"], "2024-01-02")])
    merged = {r.size_byte: r for r in catalog.upsert(old, new).collect()}
    assert len(merged) == 2 and catalog.upsert(old, new).count() == 3
    same = merged[4]
    assert same.scope_ids == ["s1", "s2", "s3"] and same.tags == ["a", "b"]
    assert "/s1/" in same.file_path and str(same.updated_at).startswith("2024-01-03") and str(same.created_at).startswith("2024-01-01")


def test_upsert_is_idempotent_and_order_independent(spark):
    old = assets(spark, [("x", "s1", ["a"], "2024-01-01")])
    new = assets(spark, [("x", "s2", ["b"], "2024-01-02"), ("y", "s2", ["b"], "2024-01-02")])
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    once = catalog.upsert(old, new)
    assert key(catalog.upsert(once, new)) == key(once)
    assert key(catalog.upsert(new, old)) == key(once)


def test_delete_prefix_is_literal_and_needs_upper_levels(spark):
    paths = ["s3a://processed-data/1_RAW/s/x", "s3a://processed-data/1XRAW/s/x", "s3a://processed-data/1_RAW/s2/x", None]
    frame = spark.createDataFrame([(p,) for p in paths], "file_path string")
    left = [r.file_path for r in catalog.delete(frame, catalog.delete_prefix("1_RAW", "s")).collect()]
    assert left == [paths[1], paths[2], None]
    assert catalog.delete_prefix("1_RAW", "s", "c", "t", "abc").endswith("/1_RAW/s/c/t/abc")
    with pytest.raises(ValueError):
        catalog.delete_prefix("1_RAW", task_id="t")
    with pytest.raises(ValueError):
        catalog.delete_prefix("9_NONE")


def test_catalog_match_ignores_absent_filters(spark):
    frame = assets(spark, [("x", "s1", [], "2024-01-01"), ("y", "s2", [], "2024-01-01")])
    assert catalog.search(frame).count() == 2
    assert catalog.search(frame, stage="2_ETL", scope_id="s1", task_id="t1").count() == 1
    assert catalog.search(frame, {"extension": "txt", "word_count": 1}, scope_id="s2").count() == 1
    assert catalog.search(frame, {"word_count": "1"}).count() == 0


def test_stamp(spark):
    row = lineage.stamp(spark.range(1), "2_ETL", "s", "c", ["t"], "k").first()
    assert (row.scope_ids, row.schedule_ids, row.tags, row.stage, row.task_ids) == (["s"], ["c"], ["t"], "2_ETL", ["k"])
