"""The catalog changed in place, the bridge against a scan, and pruned reads of catalogued files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import catalog
from tideline.plans import stages
from tideline.schemas import STAGES
from tideline.sinks import catalog_store as store
from tideline.sources import records

SHAPE = (
    "asset_id string, file_name string, file_path string, mime_type string, size_byte long, compression string, attributes string, "
    "created_at timestamp, updated_at timestamp, scope_ids array<string>, schedule_ids array<string>, task_ids array<string>, tags array<string>, stage string"
)


def assets(spark, rows, day="2024-01-01"):
    """Catalog rows from (asset, scopes, schedules, tags, stage)."""
    df = spark.createDataFrame(rows, "asset_id string, scope_ids array<string>, schedule_ids array<string>, tags array<string>, stage string")
    at = F.lit(day).cast("timestamp")
    made = df.withColumns({
        "file_name": F.concat("asset_id", F.lit(".txt")), "file_path": F.concat_ws("/", F.lit("s3a://processed-data"), "stage", "asset_id"),
        "mime_type": F.lit("text/plain"), "size_byte": F.lit(1).cast("long"), "compression": F.lit("NONE"), "attributes": F.lit("{}"),
        "created_at": at, "updated_at": at, "task_ids": F.array(F.lit("t")),
    })
    return made.select(*spark.createDataFrame([], SHAPE).columns)


def some_rows(n, seed=1):
    rng = random.Random(seed)
    pick = lambda kind: rng.choice([None, [], [f"{kind}{rng.randint(0, 5)}"], [f"{kind}{i}" for i in range(3)] + [None]])
    return [(f"asset{i}", pick("s"), pick("c"), pick("t"), rng.choice(STAGES)) for i in range(n)]


def files_of(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def shown(df):
    return sorted(map(str, df.drop("bucket").select(*df.sparkSession.createDataFrame([], SHAPE).columns).collect()))


def test_upsert_touches_only_folders_of_its_ids(spark, folder):
    whole, few = assets(spark, some_rows(200)), assets(spark, [("asset3", ["new"], ["x"], ["y"], "1_RAW"), ("other", None, None, None, "1_RAW")], "2024-02-01")
    assert len(store.upsert_catalog(whole, folder, 8)) == 8
    before = files_of(folder)
    touched = store.upsert_catalog(few, folder, 8)
    after = files_of(folder)
    assert 1 <= len(touched) <= 2
    changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert changed and {int(p.split("bucket=")[1].split("/")[0]) for p in changed} == set(touched)
    want = catalog.upsert(whole, few)
    assert shown(store.read_catalog(spark, folder, 8)) == shown(want)
    store.upsert_catalog(few, folder, 8)
    assert shown(store.read_catalog(spark, folder, 8)) == shown(want)
    assert store.upsert_catalog(few.limit(0), folder, 8) == []


def test_only_touched_folders_are_read(spark, folder):
    store.upsert_catalog(assets(spark, some_rows(50)), folder, 8)
    plan = store.read_catalog(spark, folder, 8).filter(F.col("bucket").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_delete_by_prefix(spark, folder):
    whole = assets(spark, some_rows(60))
    assert store.delete_from_catalog(spark, folder, "s3a://processed-data/1_RAW/", 8) == 0
    store.upsert_catalog(whole, folder, 8)
    prefix = catalog.delete_prefix("2_ETL")
    gone = whole.filter(catalog.below(prefix)).count()
    assert store.delete_from_catalog(spark, folder, prefix, 8) == gone > 0
    assert shown(store.read_catalog(spark, folder, 8)) == shown(catalog.delete(catalog.upsert(whole.limit(0), whole), prefix))
    for stage in STAGES:
        store.delete_from_catalog(spark, folder, catalog.delete_prefix(stage), 8)
    assert files_of(folder) == {}


@pytest.mark.parametrize("given", [{}, {"scope_ids": ["s1", "s2"]}, {"schedule_ids": ["c1"]}, {"tags": ["t0"]}, {"scope_ids": ["s1"], "schedule_ids": ["c1", "c2"]},
                                   {"scope_ids": ["s1", "s0"], "schedule_ids": ["c1"], "tags": ["t3"]}, {"scope_ids": ["none"]}])
def test_bridge_finds_what_a_scan_finds(spark, folder, given):
    whole = assets(spark, some_rows(300, 7))
    store.upsert_catalog(whole, f"{folder}/c", 8)
    store.write_bridge(whole, f"{folder}/b", 4)
    bridge, table = spark.read.parquet(f"{folder}/b"), store.read_catalog(spark, f"{folder}/c", 8)
    found = store.lineage_by_bridge(bridge, table, "2_ETL", **given, buckets=8)
    assert sorted(r.asset_id for r in found.collect()) == sorted(r.asset_id for r in catalog.lineage_search(whole, "2_ETL", **given).collect())
    one = {k.removesuffix("s"): v[0] for k, v in given.items() if k != "tags"}
    by_id = store.catalog_by_bridge(bridge, table, "2_ETL", 8, **one)
    assert sorted(r.asset_id for r in by_id.collect()) == sorted(r.asset_id for r in catalog.search(whole, stage="2_ETL", **one).collect())


def test_bridge_search_is_pruned(spark, folder):
    whole = assets(spark, some_rows(300, 7))
    store.upsert_catalog(whole, f"{folder}/c", 8)
    store.write_bridge(whole, f"{folder}/b", 4)
    found = store.lineage_by_bridge(spark.read.parquet(f"{folder}/b"), store.read_catalog(spark, f"{folder}/c", 8), "2_ETL", ["s1"], buckets=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "(kind#" in plan.split("PartitionFilters: [", 1)[1] and "EqualTo(id,s1)" in plan
    assert "dynamicpruning" in plan


def written(spark, folder, kind="json"):
    raw = spark.createDataFrame(
        [("1_RAW", s, c, "t", i, float(i)) for i, (s, c) in enumerate([("a", "c"), ("a", "d"), ("b:c", "c"), ("d e+%", "c"), ("é", "007"), (None, "c")])],
        "stage string, scope string, schedule string, task string, id long, price double",
    )
    stages.save(raw, folder, kind)
    return raw.select("id", "price").schema


def test_pruned_read_of_folders_and_files(spark, folder):
    shape = written(spark, folder)
    under = f"{folder}/stage=1_RAW"
    read = lambda hits: sorted(r.id for r in records.read_catalogued(spark, hits, under, "json", shape, levels=stages.LEVELS[1:]).collect())
    hits = stages.folder_catalog(spark, folder, "1_RAW", "json", shape, F.current_timestamp()).select("file_path")
    assert read(hits) == [0, 1, 2, 3, 4, 5] and read(hits.union(hits)) == [0, 1, 2, 3, 4, 5] and read(hits.limit(0)) == []
    paths = lambda *names: spark.createDataFrame([(n,) for n in names], "file_path string")
    assert read(paths(f"{under}/scope=a")) == [0, 1] and read(paths(f"file:{under}/scope=a/schedule=d/")) == [1]
    assert read(paths(under)) == [0, 1, 2, 3, 4, 5] and read(paths(f"{under}/scope=a", f"{under}/scope=a/schedule=c/task=t")) == [0, 1]
    assert read(paths("/nowhere/scope=a", f"{under}x/scope=a")) == []
    one = [p for p in files_of(f"{under}/scope=a/schedule=d")]
    assert read(paths(*one)) == [1] and read(paths(*one, f"{under}/scope=b%3Ac")) == [1, 2] and read(paths(f"{one[0]}x")) == []


def test_one_hit_reads_one_folder(spark, folder):
    shape = written(spark, folder, "parquet")
    under = f"{folder}/stage=1_RAW"
    hits = stages.folder_catalog(spark, folder, "1_RAW", "parquet", shape, F.current_timestamp())
    frame = records.read_catalogued(spark, hits.filter(F.array_contains("scope_ids", "b:c")), under, "parquet", shape, levels=stages.LEVELS[1:])
    assert "dynamicpruning" in frame._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in frame.collect()] == [2]


@pytest.mark.parametrize("levels", [(), ("scope",)])
def test_files_of_any_suffix_are_read(spark, folder, levels):
    os.makedirs(f"{folder}/in/scope=a")
    names = ["data.ndj", "DATA.JSON", "bare", "x.ndjson"]
    for i, name in enumerate(names):
        with open(f"{folder}/in/scope=a/{name}", "w") as file:
            file.write('{"id": %d}\n' % i)
    hits = spark.createDataFrame([(f"{folder}/in/scope=a/{n}",) for n in names[:3]], "file_path string")
    shape = records.StructType.fromDDL("id long")
    got = records.read_catalogued(spark, hits, f"{folder}/in", "json", shape, levels=levels)
    assert sorted(r.id for r in got.collect()) == [0, 1, 2]
