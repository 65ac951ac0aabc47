"""The vector index against a scan of all rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import vector_index

ROWS = "id long, embedding array<double>, stage string"


def clustered(n=1500, width=16, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, width))
    vectors = middles[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, width))
    # A third of all rows is one and the same vector.
    vectors[: n // 3] = vectors[0]
    return vectors


def odd_rows(width):
    whole = [1.0] * width
    return [
        (9001, None, "a"), (9002, [], "a"), (9003, [0.0] * width, "a"), (9004, [float("nan")] * width, "a"),
        (9005, [None, *whole[1:]], "a"), (9006, [float("inf"), *whole[1:]], "a"), (9007, whole[:-1], "a"),
    ]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    vectors = clustered()
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows + odd_rows(vectors.shape[1]), ROWS)
    path = str(tmp_path_factory.mktemp("index") / "v")
    vector_index.write_index(frame, path, vector_index.train(frame, 24, rounds=4), cell_rows=100)
    return path, vectors


def scan(vectors, ids, query, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit[ids] @ unit[query], 9)
    return [(int(ids[j]), scores[j]) for j in np.lexsort((ids, -scores))[:k]]


def asked(spark, vectors, every=50):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors) if i % every == 0]
    return spark.createDataFrame(rows + [(-1, None), (-2, [1.0])], "query_id long, embedding array<double>")


def answers(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, round(r.similarity, 9)))
    return out


def test_every_usable_row_is_kept_once_and_hot_lists_are_cut(spark, index):
    path, vectors = index
    rows = spark.read.parquet(f"{path}/rows")
    assert sorted(r.id for r in rows.select("id").collect()) == list(range(len(vectors)))
    assert rows.groupBy("list", "cell").count().agg(F.max("count")).first()[0] < 200


@pytest.mark.parametrize("probes", [1, 4])
def test_exact_search_is_a_scan(spark, index, probes):
    path, vectors = index
    got = answers(vector_index.search(spark, path, asked(spark, vectors), 5, probes, exact=True, block_queries=7))
    ids = np.arange(len(vectors))
    assert set(got) == {i for i in range(0, len(vectors), 50)}
    for query, found in got.items():
        want = scan(vectors, ids, query, 5)
        assert [s for _, s in found] == pytest.approx([s for _, s in want], abs=1e-8)
        clear = {i for i, s in want if s > want[-1][1] + 1e-8}
        assert clear <= {i for i, _ in found}


def test_recall_of_the_probed_lists(spark, index):
    path, vectors = index
    got = answers(vector_index.search(spark, path, asked(spark, vectors), 5, 6))
    hits = total = 0
    for query, found in got.items():
        want = scan(vectors, np.arange(len(vectors)), query, 5)
        hits += sum(s >= want[-1][1] - 1e-8 for _, s in found)
        total += 5
    assert hits / total >= 0.9


def test_condition_before_the_search(spark, index):
    path, vectors = index
    ids = np.arange(len(vectors))[1::2]
    got = answers(vector_index.search(spark, path, asked(spark, vectors, 300), 4, 2, exact=True, prefilter=F.col("stage") == "b"))
    for query, found in got.items():
        assert [s for _, s in found] == pytest.approx([s for _, s in scan(vectors, ids, query, 4)], abs=1e-8)
        assert all(i % 2 for i, _ in found)


def test_only_probed_lists_are_read(spark, index):
    path, vectors = index
    one = asked(spark, vectors, 100_000)
    found = vector_index.search(spark, path, one, 5, 2)
    assert spark.read.parquet(f"{path}/lists").count() > 4
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = [f for f in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if "list#" in f]
    named = re.search(r"IN \(([\d,]+)\)", filters[0])
    assert len(filters) == 1 and len(named[1].split(",")) == 2, "one query with two probes opens two lists"


def test_empty_index_and_fewer_rows_than_asked(spark, folder):
    none = spark.createDataFrame([], ROWS)
    vector_index.write_index(none, f"{folder}/none", vector_index.train(none, 4))
    one = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 1.0], "a")], ROWS)
    vector_index.write_index(one, f"{folder}/one", vector_index.train(one, 4))
    query = spark.createDataFrame([(7, [0.0, 2.0])], "query_id long, embedding array<double>")
    assert vector_index.search(spark, f"{folder}/none", query, 3, exact=True).count() == 0
    got = vector_index.search(spark, f"{folder}/one", query, 3, 1, exact=True).orderBy("rank").collect()
    assert [(r.id, round(r.similarity, 6)) for r in got] == [(2, 0.707107), (1, 0.0)]
