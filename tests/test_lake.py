"""Readers, writers and the batch jobs on small files."""

import json
import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tideline import scratch_dir
from tideline.operators import catalog, insights, metadata, scoring, similarity
from tideline.plans import clean_embed, stages
from tideline.schemas import FILE_ASSET, LAKE_ROW, RAW_RECORD
from tideline.sinks import catalog_store, lake
from tideline.sources import files, records
from tideline.sources.jdbc import database_rows

NEWS = [
    {"title": "t1", "content": "hello", "published_date": "2024-01-01", "url": "http://x/1"},
    {"title": "t2", "content": None, "published_date": "2024-01-01", "url": None},
    {"title": "t3", "content": "", "published_date": None, "url": None},
]
PRICES = [{"ticker": "AAPL", "price": 1.5, "timestamp": "2024-01-01 00:00:00"}]


def put(path, value):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        file.write(value if isinstance(value, str) else json.dumps(value, indent=1))


def test_missing_path_gives_no_rows_but_other_errors_are_raised(spark, folder):
    empty = records.or_empty(spark, lambda: records.read_json(spark, f"{folder}/none"), LAKE_ROW)
    assert empty.count() == 0 and empty.schema == LAKE_ROW
    put(f"{folder}/x.json", NEWS)
    with pytest.raises(AnalysisException):
        records.or_empty(spark, lambda: records.read_json(spark, f"{folder}/x.json", multiline=True).select("nope"), LAKE_ROW)


def test_harmonise_fills_each_column_on_its_own(spark, folder):
    put(f"{folder}/news.json", NEWS)
    put(f"{folder}/prices.json", PRICES)
    news = clean_embed.harmonise(records.read_json(spark, f"{folder}/news.json", multiline=True), F.lit("src"))
    assert [(r.content, r.source_reference) for r in news.orderBy("title").collect()] == [("hello", "http://x/1"), (None, "src"), ("", "src")]
    prices = records.with_file(records.read_json(spark, f"{folder}/prices.json", multiline=True))
    row = clean_embed.harmonise(prices, F.col("file_path")).first()
    assert row.content.startswith("Data from file:") and row.title == "AAPL" and row.published_date == "2024-01-01 00:00:00"
    bare = clean_embed.harmonise(spark.createDataFrame([("c",)], "content string"), F.lit("src")).first()
    assert bare.title == "Unknown Title" and bare.published_date is not None


def test_etl_writes_the_same_ids_to_both_sinks_and_replaces_only_its_partition(spark, folder):
    raw = spark.createDataFrame([(n["title"], n["content"], n["published_date"], n["url"]) for n in NEWS], "title string, content string, published_date string, url string")
    for scope in ("s1", "s2", "s1"):
        asset = clean_embed.run(spark, raw, F.lit("in"), "in", scope, "c", f"{folder}/lake", f"{folder}/vec", ["t"], dim=4)
    stored = spark.read.parquet(f"{folder}/lake")
    assert stored.groupBy("scope").count().orderBy("scope").collect() == [("s1", 2), ("s2", 2)]
    vectors = spark.read.parquet(f"{folder}/vec")
    assert {r.id for r in stored.collect()} == {r.id for r in vectors.collect()}
    assert vectors.filter("chunk_text = ''").first().embedding == [0.0] * 4
    row = asset.first()
    assert row.size_byte > 0 and json.loads(row.attributes)["row_count"] == 2 and set(asset.columns) == set(FILE_ASSET.names)


def test_dataset_id_names_the_content_not_the_files(spark, folder):
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"))
    rows.repartition(7).write.parquet(f"{folder}/a")
    rows.coalesce(1).write.parquet(f"{folder}/b")
    rows.filter("id <> '5'").write.parquet(f"{folder}/c")
    ids = [
        catalog.register_dataset(spark.read.parquet(f"{folder}/{x}"), "id", "n", "p", "s", "2_ETL", "s", "c").first().asset_id for x in "abc"
    ]
    assert ids[0] == ids[1] != ids[2]


def test_catalogued_reads_of_files_and_folders(spark, folder):
    raw = spark.createDataFrame(
        [("1_RAW", s, "c", "t", i, float(i)) for i, s in enumerate(["a", "a", "b:c", "d e"])],
        "stage string, scope string, schedule string, task string, id long, price double",
    )
    stages.save(raw, folder, "json")
    shape = raw.select("id", "price").schema
    read = lambda hits: sorted(r.id for r in records.read_catalogued(spark, hits, folder, "json", shape).collect())
    folders = stages.folder_catalog(spark, folder, "1_RAW", "json", shape, F.current_timestamp())
    assert read(folders) == [0, 1, 2, 3]
    some = folders.filter(F.col("scope_ids")[0].isin("a", "d e"))
    assert read(some) == [0, 1, 3] and read(some.unionByName(some)) == [0, 1, 3] and read(some.limit(0)) == []
    files_of = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    hits = files_of.select(F.col("path").alias("file_path"))
    assert read(hits) == [0, 1, 2, 3]
    assert read(hits.filter(F.col("file_path").contains("b%3Ac"))) == [2]
    nested = spark.createDataFrame([(f"{folder}/stage=1_RAW/",)], "file_path string")
    assert read(nested) == [0, 1, 2, 3]
    lost = spark.range(20_000).select(F.format_string("/nowhere/%d", "id").alias("file_path"))
    assert read(lost) == [] and read(lost.union(some.select("file_path"))) == [0, 1, 3]


def test_ragged_parquet_keeps_lacking_columns_null(spark, folder):
    spark.createDataFrame([(1, 2.0)], "id int, price double").write.parquet(f"{folder}/a")
    spark.createDataFrame([(2,)], "id int").write.parquet(f"{folder}/b")
    hits = spark.createDataFrame([(f"{folder}/a",), (f"{folder}/b",)], "file_path string")
    got = records.read_catalogued(spark, hits, folder, "parquet").collect()
    assert {(r.id, r.price) for r in got} == {(1, 2.0), (2, None)}


def test_average_counts_null_prices_and_skips_files_without_the_column(spark, folder):
    spark.createDataFrame([(1, 2.0), (2, None)], "id int, price double").coalesce(1).write.parquet(f"{folder}/a")
    spark.createDataFrame([(3,)], "id int").coalesce(1).write.parquet(f"{folder}/b")
    seen = files.inspect_files(files.scan_files(spark, folder, "*.parquet"))
    priced = seen.select("file_path", files.has_column("price").alias("has_price"))
    rows = records.with_file(spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(folder))
    joined = rows.withColumn("file_path", F.regexp_replace("file_path", "^file:/+", "/")).join(
        priced.withColumn("file_path", F.regexp_replace("file_path", "^file:/+", "/")), "file_path"
    )
    result = insights.average_price(joined, [], has_price=F.col("has_price")).first()
    assert (result.average_price, result.row_count) == (1.0, 2)
    nothing = insights.average_price(joined.limit(0), []).first()
    assert (nothing.average_price, nothing.row_count) == (0.0, 0)


def test_inspection_reports_failures_in_the_row(spark, folder):
    put(f"{folder}/in/a.csv", "x,y\n1,2\n\n3,4\n")
    put(f"{folder}/in/b.txt", "one two\nthree")
    put(f"{folder}/in/e.bin", "zz")
    pd.DataFrame({"p": [1, 2, 3]}).to_parquet(f"{folder}/in/c.parquet")
    with open(f"{folder}/in/d.parquet", "wb") as file:
        file.write(b"not parquet")
    with open(f"{folder}/in/f.txt", "wb") as file:
        file.write(b"\xff\xfe\xfa")
    rows = files.inspect_files(files.scan_files(spark, f"{folder}/in")).collect()
    got = {os.path.basename(r.file_path): (r, json.loads(r.attributes)) for r in rows}
    custom = {k: v[1]["custom_metadata"] for k, v in got.items()}
    assert custom["a.csv"] == {"extension": "csv", "columns": ["x", "y"], "row_count": 2, "column_count": 2}
    assert custom["b.txt"] == {"extension": "txt", "line_count": 2, "word_count": 3, "encoding": "utf-8"}
    assert custom["c.parquet"] == {"extension": "parquet", "columns": ["p"], "row_count": 3, "column_count": 1}
    assert custom["e.bin"] == {"extension": "bin"}
    assert "inspection_error" in custom["d.parquet"] and "inspection_error" in custom["f.txt"]
    row, whole = got["b.txt"]
    assert whole["size_byte"] == row.size_byte == 13 and whole["hash_algorithm"] == "SHA-256" and row.mime_type == "text/plain"


def test_image_stats(spark, folder):
    # A 4 x 3 portable pixmap is not known to Java; a BMP made by hand is.
    width, height = 4, 3
    body = b"".join(bytes([10, 20, 30] * width) for _ in range(height))
    size = 54 + len(body)
    head = b"BM" + size.to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + b"\0" * 24
    with open(f"{folder}/a.bmp", "wb") as file:
        file.write(head + info + body)
    put(f"{folder}/b.png", "broken")
    rows = {os.path.basename(r.file_path): r for r in files.image_stats(spark, folder).collect()}
    a, b = rows["a.bmp"], rows["b.png"]
    assert (a.width, a.height, a.channels, a.aspect_ratio, a.inspection_error) == (4, 3, 3, 1.33, None)
    assert b.width is None and b.inspection_error
    put(f"{folder}/c.txt", "one line")
    seen = files.with_image_stats(files.inspect_files(files.scan_files(spark, folder)), files.image_stats(spark, folder))
    custom = {os.path.basename(r.file_path): json.loads(r.attributes)["custom_metadata"] for r in seen.collect()}
    assert custom["a.bmp"] == {"extension": "bmp", "width": 4, "height": 3, "channels": 3, "aspect_ratio": 1.33}
    assert custom["b.png"] == {"extension": "png", "inspection_error": "unreadable image"}
    assert custom["c.txt"]["line_count"] == 1


def test_csv(spark, folder):
    put(f"{folder}/a.csv", "ticker,price\nA,1.5\n")
    assert records.read_csv(spark, f"{folder}/a.csv").first() == ("A", 1.5)
    assert RAW_RECORD["price"].dataType.simpleString() == "double"


def test_records_saved_twice_stay_and_are_found(spark, folder):
    def rows(*bodies):
        frame = spark.createDataFrame([(b,) for b in bodies], "j string")
        return frame.withColumns({"scope": F.lit("a:b"), "schedule": F.lit("h 1"), "task": F.lit(None).cast("string")})

    def save(*bodies):
        return lake.save_records(rows(*bodies), "j", f"{folder}/store", "1_RAW", "scope", "schedule", "task", [], F.current_timestamp())

    first = save('{"b":1, "a":2}', '{"a":2,"b":1}').collect()
    assert first[0].asset_id == first[1].asset_id and first[0].size_byte == len('{"a":2,"b":1}')
    second = save('{"k":2}', '{"a":2,"b":1}')
    again = save('{"k":2}')
    hits = second.unionByName(again).unionByName(spark.createDataFrame(first, second.schema))
    got = lake.read_records(spark, f"{folder}/store", hits).collect()
    assert sorted(r.body for r in got) == ['{"a":2,"b":1}', '{"k":2}']
    assert {(r.scope, r.schedule, r.task) for r in got} == {("a:b", "h 1", None)}
    assert lake.read_records(spark, f"{folder}/none", hits).count() == 0


def test_deleted_records_are_gone_from_store_and_catalog(spark, folder):
    frame = spark.createDataFrame([("a:b", "t", '{"k":1}'), ("a:b", "t", '{"k":2}'), ("a:b", "u", '{"k":3}'), ("c", "t", '{"k":4}')], "scope string, task string, j string")
    frame = frame.withColumn("schedule", F.lit("h"))
    assets = lake.save_records(frame, "j", f"{folder}/store", "1_RAW", "scope", "schedule", "task", [], F.current_timestamp())
    assets.write.parquet(f"{folder}/assets")
    assets = spark.read.parquet(f"{folder}/assets")
    bodies = lambda: sorted(r.body for r in lake.read_records(spark, f"{folder}/store", assets).collect())
    one = assets.filter(F.sha2(F.lit('{"k":1}'), 256) == F.col("asset_id")).first().asset_id
    left, count = lake.delete_records(spark, assets, f"{folder}/store", "1_RAW", "a:b", "h", "t", one)
    assert count == 1 and left.count() == 3 and bodies() == ['{"k":2}', '{"k":3}', '{"k":4}']
    left, count = lake.delete_records(spark, left, f"{folder}/store", "1_RAW", "a:b")
    assert count == 2 and [r.scope_ids for r in left.collect()] == [["c"]] and bodies() == ['{"k":4}']
    assert lake.delete_records(spark, left, f"{folder}/store", "2_ETL")[1] == 0
    with pytest.raises(ValueError):
        lake.delete_records(spark, left, f"{folder}/store", "1_RAW", None, "h")


def test_insights_append_and_schedule_export(spark, folder):
    data = F.array(F.struct(F.lit("t").alias("time"), F.lit(1.0).alias("price")))
    series = spark.range(1).select(F.lit("s").alias("scope_id"), F.lit("A").alias("ticker"), F.lit(0).alias("part"), data.alias("data"))
    none = spark.createDataFrame([], "scope_id string, sentiment string")
    documents = insights.dashboard_documents(series, none, ["scope_id"])
    assert documents.first().insight_type == "Neutral"
    lake.append_insights(documents, f"{folder}/insights")
    lake.append_insights(documents, f"{folder}/insights")
    assert spark.read.json(f"{folder}/insights").count() == 2


SCHEDULES = [(1, 10, "CRON", "0 8 * * *"), (2, 10, "CRON", "1 8 * * *"), (3, 10, "ONCE", None), (4, 11, "CRON", None), (5, 12, "CRON", "* * * * *")]
TASKS = [
    (101, 1, "ETL", 7, 199, 2), (102, 1, "SEARCH", 7, None, 1), (103, 1, "ETL", None, 101, None), (104, 1, "ETL", 8, 102, 2),
    (301, 3, "ETL", 7, None, 1), (501, 5, "ETL", 8, None, 1), (502, 5, "ETL", 7, 501, 2), (503, 5, "ETL", 7, 102, 3),
]
TOOLS = [(7, "u7", '{"expected_file_type":"csv"}', '{"file_type":"json"}'), (8, "u8", '{"expected_file_type":"json"}', None), (9, "u9", None, "{}")]


def graph(spark):
    schedules = spark.createDataFrame(SCHEDULES, "schedule_id long, scope_id long, execution_type string, cron_expression string")
    tasks = spark.createDataFrame(TASKS, "task_id long, schedule_id long, task_type string, tool_id long, depends_on_task_id long, execution_order int")
    tools = spark.createDataFrame(TOOLS, "tool_id long, script_url string, input_schema string, output_schema string")
    return schedules, tasks, tools


@pytest.mark.parametrize("size", [2, 10_000])
def test_nested_schedules(spark, folder, size):
    nested = metadata.nested_schedules(metadata.cron_tasks(*graph(spark)), size)
    got = {}
    for r in nested.orderBy("schedule_id", "part").collect():
        got.setdefault(r.schedule_id, []).extend(t.task_id for t in r.tasks)
        assert len(r.tasks) <= size
    assert got == {1: [102, 101, 104, 103], 2: [], 5: [501, 502, 503]}
    lake.export_schedules(nested, f"{folder}/export")
    lake.export_schedules(nested, f"{folder}/export")
    lines = [json.loads(r.value) for r in spark.read.text(f"{folder}/export").collect()]
    assert sum(x["schedule_id"] == 2 and x["tasks"] == [] for x in lines) == 1


def test_edges_drop_dangling_and_foreign_parents(spark):
    edges = metadata.task_edges(graph(spark)[1])
    assert sorted((r.source, r.target) for r in edges.collect()) == [(101, 103), (102, 104), (501, 502)]


def test_connections(spark):
    pairs = spark.createDataFrame([(7, 8), (8, 7), (8, 9), (7, 99)], "source_tool_id long, target_tool_id long")
    got = {(r.source_tool_id, r.target_tool_id): (r.valid, r.reason) for r in metadata.connection_valid(pairs, graph(spark)[2]).collect()}
    assert got == {
        (7, 8): (True, None),
        (8, 7): (False, "File type mismatch: Output is None but Input expects csv"),
        (8, 9): (True, None),
    }
    strict = {(r.source_tool_id, r.target_tool_id): r.valid for r in metadata.connection_valid(pairs, graph(spark)[2], strict=True).collect()}
    assert strict[(8, 9)] is False and strict[(7, 8)] is True


def test_cascade(spark):
    schedules, tasks, tools = graph(spark)
    scopes = spark.createDataFrame([(10,), (11,), (12,)], "scope_id long")
    gone = lambda c, v: spark.createDataFrame([(v,)], f"{c} long")
    left = metadata.cascade_delete(scopes, schedules, tasks, tools, gone_scopes=gone("scope_id", 10))
    assert sorted(r.task_id for r in left["tasks"].collect()) == [501, 502, 503]
    assert {r.task_id: r.depends_on_task_id for r in left["tasks"].collect()}[503] is None
    left = metadata.cascade_delete(scopes, schedules, tasks, tools, gone_tools=gone("tool_id", 7))
    assert {r.task_id: r.depends_on_task_id for r in left["tasks"].collect()} == {103: None, 104: None, 501: None}
    left = metadata.cascade_delete(scopes, schedules, tasks, tools, gone_schedules=gone("schedule_id", 5))
    assert left["schedules"].count() == 4 and left["scopes"].count() == 3


def test_newest_insight_has_no_fallback(spark):
    shape = "schedule_id int, created_at int, id int, blocks array<string>"
    frame = spark.createDataFrame([(1, 1, 1, ["old"]), (1, 2, 2, None), (2, 1, 1, ["a"]), (2, 1, 2, ["b"])], shape)
    got = {r.schedule_id: r.blocks for r in insights.newest_blocks(frame, ["created_at", "id"]).collect()}
    assert got == {1: [], 2: ["b"]}


def test_similarity_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = np.round(rng.normal(size=(120, 5)), 1)
    vectors[3] = 0
    vectors[10:20] = vectors[9]
    passages = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, None)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(q, vectors[q].tolist()) for q in (9, 1, 3, 50)], "query_id long, embedding array<double>")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    want = {}
    for q in (9, 1, 50):
        scores = [(round(float(unit[q] @ unit[i]), 9), i) for i in range(120) if i != 3]
        want[q] = [i for _, i in sorted(scores, key=lambda s: (-s[0], s[1]))[:4]]
    for block in (1024, 2):
        found = similarity.similar_topk(spark, passages.repartition(3), queries, 4, block_queries=block, block_passages=20 * block).collect()
        got = {}
        for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r.id)
        assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}
    assert similarity.similar_topk(spark, passages, queries.limit(0), 4).count() == 0
    assert similarity.similar_topk(spark, passages.limit(0), queries, 4).count() == 0


def test_nearest_step_holds_a_tile_of_scores():
    rng = np.random.default_rng(3)
    vectors = np.tile(rng.normal(size=(50, 4)), (400, 1))
    passages = pd.DataFrame({"id": np.arange(20_000)[::-1], "passage": list(vectors)})
    queries = pd.DataFrame({"query_id": np.arange(400), "query": list(vectors[:400])})
    tracemalloc.start()
    found = similarity._nearest(queries, passages, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All scores at once are 64 MB.
    assert peak < 48 << 20
    # The 400 copies of a query's vector tie; the smallest ids come first.
    got = found.sort_values(["query_id", "similarity", "id"], ascending=[True, False, True]).groupby("query_id")["id"].apply(list)
    assert all(ids == [49 - q % 50, 99 - q % 50, 149 - q % 50] for q, ids in got.items()) and len(got) == 400


def test_approximate_similarity_finds_most(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    vectors = np.concatenate([c + 0.1 * rng.normal(size=(25, 16)) for c in centres])
    passages = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(9999, None), (9998, [0.0] * 16)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(0, 1000, 20)], "query_id long, embedding array<double>")
    exact = {(r.query_id, r.id) for r in similarity.similar_topk(spark, passages, queries, 5).collect()}
    found = {(r.query_id, r.id) for r in similarity.similar_approx(passages, queries, 5).collect()}
    assert len(exact) == 250 and len(exact & found) >= 0.9 * len(exact)


def test_user_functions(spark):
    frame = spark.createDataFrame([(1, "up up down", 5.0), (2, "down", 7.0)], "id int, content string, v double")
    assert [r.score for r in scoring.score_text(frame, _lengths, "content").orderBy("id").collect()] == [10.0, 4.0]
    assert scoring.embed(frame, _pairs).orderBy("id").first().embedding == [10.0, 1.0]
    native = frame.select(scoring.lexicon_label(scoring.lexicon_score("content", ["up"], ["down"])).alias("l"))
    assert sorted(r.l for r in native.collect()) == ["Bearish", "Bullish"]
    out = scoring.apply_to_series(frame, _double, "id int, v double", ["id"], F.lit(0))
    assert sorted(r.v for r in out.collect()) == [10.0, 14.0]
    with pytest.raises(ValueError):
        scoring.run_stage(lambda df, args: df, frame, {"scope_id": "s"})
    kept = scoring.run_stage(lambda df, args: df.withColumn("x", F.lit(args["extra"])), frame, {"scope_id": "s", "schedule_id": "c", "task_id": "t", "extra": "e"})
    assert kept.first().x == "e"


def _lengths(texts: pd.Series) -> pd.Series:
    return texts.str.len().astype(float)


def _pairs(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [float(len(t)), 1.0])


def _double(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf[["id"]].assign(v=pdf["v"] * 2)


def test_scratch_is_under_the_shared_folder(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_stages_without_prices(spark, folder):
    raw = spark.createDataFrame([("1_RAW", "s", "c", "t", "news")], "stage string, scope string, schedule string, task string, content string")
    row = stages.run(spark, raw, folder, F.current_timestamp()).first()
    assert row.insight_type == "Bearish" and row.ticker == "N/A" and row.blocks[0].label == "N/A Signal"
    assert [(p.time, p.price) for p in row.blocks[1].data] == [("N/A", 0.0)]


def test_stages_with_any_ids_and_a_second_run(spark, folder):
    shape = "stage string, scope string, schedule string, task string, id string, ticker string, price double, timestamp string"
    rows = [("1_RAW", "a:b", "h 1", "t/%", "1", "A", 300.0, "2024-01-01 00:00:00"), ("1_RAW", "c", "ü+", "t", "2", "B", 10.0, "2024-01-01 00:00:01")]
    raw = spark.createDataFrame(rows, shape)
    found = stages.run(spark, raw, folder, F.current_timestamp())
    want = {("a:b", "h 1", "Bullish", 300.0), ("c", "ü+", "Bearish", 10.0)}
    assert {(r.scope, r.schedule, r.insight_type, r.blocks[1].data[0].price) for r in found.collect()} == want
    assets = catalog_store.read_catalog(spark, f"{folder}/file_assets")
    assert {r.stage: r.n for r in assets.groupBy("stage").agg(F.count("*").alias("n")).collect()} == {"1_RAW": 2, "2_ETL": 2, "3_ANALYZE": 2}
    assert assets.filter("size_byte <= 0").count() == 0
    more = spark.createDataFrame([("1_RAW", "d", "x", "t", "3", "C", 1.0, "2024-01-01 00:00:02")], shape)
    assert stages.run(spark, more, folder, F.current_timestamp()).select("scope").distinct().count() == 3


def test_etl_without_rows_clears_its_partition(spark, folder):
    raw = spark.createDataFrame([("t", "text", "u")], "title string, content string, url string")
    run = lambda rows: clean_embed.run(spark, rows, F.lit("in"), "in", "a:b", "h 1", f"{folder}/lake", f"{folder}/vec", dim=4).first()
    assert json.loads(run(raw.limit(0)).attributes)["row_count"] == 0
    assert json.loads(run(raw).attributes)["row_count"] == 1
    assert spark.read.parquet(f"{folder}/lake").first().scope == "a:b"
    assert json.loads(run(raw.limit(0)).attributes)["row_count"] == 0
    assert spark.read.parquet(f"{folder}/lake").count() == spark.read.parquet(f"{folder}/vec").count() == 0


def test_newest_insights(spark):
    rows = spark.range(60).select(
        F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id") % 7).alias("created_at"), F.lit("4_VISUALIZE").alias("stage"),
        F.array(F.lit("s")).alias("scope_ids"), F.array(F.lit("c")).alias("schedule_ids"), F.array(F.lit("t")).alias("tags"),
    )
    page = catalog.newest_insights(rows, "4_VISUALIZE", limit=catalog.DASHBOARD_LIMIT).collect()
    assert [r.created_at.second for r in page] == [6] * 8 + [5] * 2 and catalog.newest_insights(rows, "4_VISUALIZE").count() == 50


def test_database_rows(spark):
    rows = spark.createDataFrame([("a", ["x", "y"], []), ("b", None, ["z"])], "id string, scope_ids array<string>, tags array<string>")
    assert [tuple(r) for r in database_rows(rows).collect()] == [("a", "{x,y}", "{}"), ("b", None, "{z}")]
