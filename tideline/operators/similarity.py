"""Top-k passages by cosine similarity, exact and approximate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.insights import top_rows


def similar_topk(
    spark: SparkSession,
    passages: DataFrame,
    queries: DataFrame,
    k: int,
    prefilter: Column | None = None,
    block_queries: int = 1024,
    block_passages: int = 20_000,
) -> DataFrame:
    """The ``k`` passages nearest to each query, with rank and similarity.

    ``passages`` is (id, embedding) and ``queries`` (query_id, embedding). Both are dealt into
    blocks by a hash; each block of queries meets each block of passages in one task, which keeps
    its k best per query, and only those are merged. So the plan is one pass whatever the number
    of queries, no vector passes through the driver, and a task holds one block of either side and
    the scores of one tile of them. The work is that of all pairs; ``similar_approx`` does less. Zero
    vectors have no direction and match nothing; queries without an id are left out. Scores are
    rounded to 12 decimals, so that copies of a vector score alike wherever they lie; equal scores rank by id.
    """
    if prefilter is not None:
        passages = passages.filter(prefilter)
    # Aliased, so that both sides may come from one table.
    passages = passages.filter("embedding is not null").select(F.col("id").alias("id"), F.col("embedding").alias("passage"))
    queries = queries.filter("embedding is not null and query_id is not null").select(F.col("query_id").alias("query_id"), F.col("embedding").alias("query"))
    kinds = {f.name: f.dataType.simpleString() for f in (*passages.schema.fields, *queries.schema.fields)}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double"
    n_query = max(1, -(-queries.count() // block_queries))
    n_passage = max(1, -(-passages.count() // block_passages))

    def dealt(rows: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        placed = rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    asked = dealt(queries, "query_id", "__q", n_query, "__p", n_passage).groupBy("__q", "__p")
    held = dealt(passages, "id", "__p", n_passage, "__q", n_query).groupBy("__q", "__p")
    found = asked.cogroup(held).applyInPandas(lambda q, p: _nearest(q, p, k), schema)
    return top_rows(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k)


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; a vector without a direction gives nan."""
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.full_like(rows, np.nan), where=lengths > 0)


def _nearest(queries: pd.DataFrame, passages: pd.DataFrame, k: int, tile: int = 2048) -> pd.DataFrame:
    """The k best passages of each query, from the scores of 1,024 queries and ``tile`` passages at a time."""
    # In the order of their ids, so that of equal scores the first count.
    passages = passages.sort_values("id", na_position="first", kind="stable")
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    for first in range(0, len(queries), 1024):
        asked = _unit(queries["query"].iloc[first : first + 1024])
        best, where = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k), dtype=np.int64)
        for start in range(0, len(passages), tile):
            held = _unit(passages["passage"].iloc[start : start + tile])
            scores = np.concatenate((best, np.round(asked @ held.T, 12)), axis=1)
            scores[np.isnan(scores)] = -np.inf
            kept = _first_best(scores, k)
            at = np.concatenate((where, np.broadcast_to(np.arange(start, start + len(held)), (len(asked), len(held)))), axis=1)
            best, where = scores[kept].reshape(-1, k), at[kept].reshape(-1, k)
        q, place = np.nonzero(best > -np.inf)
        found.append((first + q, where[q, place], best[q, place]))
    q, p, score = map(np.concatenate, zip(*found))
    return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[q], "id": passages["id"].to_numpy()[p], "similarity": score})


def _first_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Marks the k highest scores of each row; of those equal to the k-th, the first."""
    floor = np.partition(scores, -k, axis=1)[:, [-k]]
    kept, level = scores > floor, scores == floor
    wanted = k - kept.sum(axis=1)
    crowded = np.flatnonzero(level.sum(axis=1) > wanted)
    level[crowded] &= np.cumsum(level[crowded], axis=1, dtype=np.int32) <= wanted[crowded, None]
    return kept | level


def similar_approx(
    passages: DataFrame, queries: DataFrame, k: int, distance: float = 0.8, tables: int = 8, width: float = 0.5, seed: int = 11
) -> DataFrame:
    """As ``similar_topk`` for most of the passages within ``distance`` of a query.

    Random projections of the unit vectors are cut into buckets of ``width``, in ``tables``
    independent ways; vectors that share a bucket are compared. More tables or wider buckets
    find more and compare more. The distance is that of unit vectors, sqrt(2 - 2 cosine).
    """

    first = passages.filter("size(embedding) > 0").select(F.size("embedding")).first()
    width_of = first[0] if first else 1
    rng = np.random.default_rng(seed)
    lines = [(rng.normal(size=width_of).tolist(), float(rng.uniform(0, width))) for _ in range(tables)]

    def product(left: Column, right: Column) -> Column:
        return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def hashed(rows: DataFrame, key: str, name: str) -> DataFrame:
        plain = rows.select(F.col(key).alias(key), F.col("embedding").cast("array<double>").alias(name))
        length = F.sqrt(product(F.col(name), F.col(name)))
        unit = plain.withColumn(name, F.transform(name, lambda x: F.try_divide(x, length))).filter(f"{name} is not null and {name}[0] is not null")
        places = [F.floor((product(F.col(name), F.array(*map(F.lit, line))) + F.lit(shift)) / width) for line, shift in lines]
        return unit.select("*", F.posexplode(F.array(*places)).alias("table", "bucket"))

    near = hashed(queries, "query_id", "q").join(hashed(passages, "id", "p"), ["table", "bucket"])
    near = near.dropDuplicates(["query_id", "id"]).select("query_id", "id", product(F.col("q"), F.col("p")).alias("similarity"))
    close = near.filter(F.col("similarity") >= 1 - distance * distance / 2)
    return top_rows(close, ["query_id"], [F.desc("similarity"), F.asc("id")], k)


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Mean vector per group, one query per group."""
    parts = vectors.select(by, F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One entry per dimension: the array's length is the vector width.
    return means.groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("embedding")
    ).withColumnRenamed(by, "query_id")
