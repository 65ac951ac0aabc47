"""Approximate nearest neighbours by shifted Hilbert orderings.

Vectors are projected to a few dimensions by several random rotations; each projection is
ordered along a Hilbert curve and range-partitioned into buckets of the key. A query is compared
with the buckets around its own on each curve; the curves' finds merge and are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import stored

CURVES, DIMS, BITS = 4, 6, 8
BUCKETS, BUCKET_ROWS, MOST_ROWS = 64, 256, 50_000
FIT_VECTORS, FIT_QUERIES, TARGET = 20_000, 200, 0.96
QUERY_ROWS = 20_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows, dims) below 2**bits: each axis' turn and
    flip is undone from the highest bit down, then the Gray code, then bits interleave."""
    x = cells.T.astype(np.int64)
    dims = len(x)
    for shift in range(bits - 1, 0, -1):
        high, low = 1 << shift, (1 << shift) - 1
        for axis in range(dims):
            flip = (x[axis] & high) != 0
            swap = np.where(flip, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    for shift in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> shift & 1, (1 << shift) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for shift in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = key << 1 | (x[axis] >> shift & 1)
    return key


def vectors_of(cells: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype="<f8").reshape(len(cells), -1)


@dataclass
class Curves:
    """The fitted orderings: rotations, shifted grids and the key cuts between buckets."""

    rotations: list[np.ndarray]
    low: list[np.ndarray]
    width: list[np.ndarray]
    cuts: list[np.ndarray]
    reach: int = 0

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        """Curve place above, and 12 bits of the vector's own below, to part equal places."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        cells = (unit @ self.rotations[curve] - self.low[curve]) / self.width[curve] * (1 << BITS)
        own = np.abs(unit[:, 0] * 1e7).astype(np.int64) & 0xFFF
        return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS) << 12 | own

    def buckets(self, x: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.cuts[curve], self.keys(x, curve), side="right")


def fit_curves(sample: np.ndarray, n_buckets: int, curves: int = CURVES, seed: int = 7) -> Curves:
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    made = Curves([], [], [], [])
    for curve in range(curves):
        dims = min(DIMS, sample.shape[1])
        rotation = np.linalg.qr(rng.standard_normal((sample.shape[1], dims)))[0]
        seen = unit @ rotation
        low, high = np.quantile(seen, 0.001, axis=0), np.quantile(seen, 0.999, axis=0)
        width = np.maximum(high - low, 1e-9) * 1.25
        made.rotations.append(rotation)
        # Each curve's grid is shifted by another part of the margin.
        made.low.append(low - width * 0.2 * curve / curves)
        made.width.append(width)
        keys = made.keys(sample, curve)
        made.cuts.append(np.unique(np.quantile(keys, np.arange(1, n_buckets) / n_buckets, method="lower")))
    return made


def _best(scores: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Per row the k columns with the largest scores, ties to the smaller ``first``."""
    if scores.shape[1] > k:
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        return np.stack([c[np.lexsort((first[c], -row[c]))][:k] for row, c in ((r, np.flatnonzero(r >= e - 1e-12)) for r, e in zip(scores, edge))])
    return np.stack([np.lexsort((first, -row)) for row in scores])


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of x with rows of y in double precision."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def distinct_vectors(vectors: DataFrame, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Vectors that take part: (vid, vec, ids) once per different vector with its k + 1 smallest
    vec_ids, and (query_id, vid) of all rows whose vec_id is divisible by ``every``.

    Tasks keep only k + 1 ids of a vector before anything is shuffled, so a vector of a third of
    the rows costs a few ids per task. Rows without id, or with a null, empty or zero vector, or
    with components that are null or not finite take no part; nor do those of another length
    than most rows have. Repeated rows count once.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        "vec_id is not null and v is not null and size(v) > 0"
        " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    rows = rows.filter(F.size("v") == (sizes[0][0] if sizes else 0))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[bytes, list[int]] = {}
        for batch in batches:
            for vec_id, v in zip(batch["vec_id"], batch["v"]):
                ids = kept.setdefault(np.asarray(v, dtype="<f8").tobytes(), [])
                ids.append(vec_id)
                if len(ids) > 64:
                    ids[:] = sorted(set(ids))[: k + 1]
            if len(kept) > 50_000:
                yield pd.DataFrame({"vec": list(kept), "ids": [sorted(set(i))[: k + 1] for i in kept.values()]})
                kept = {}
        if kept:
            yield pd.DataFrame({"vec": list(kept), "ids": [sorted(set(i))[: k + 1] for i in kept.values()]})

    parts = rows.mapInPandas(gather, "vec binary, ids array<long>")
    once = parts.groupBy("vec").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    )
    once = stored(once.withColumn("vid", F.monotonically_increasing_id()).select("vid", "vec", "ids"), "vectors")

    def as_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"query_id": batch["vec_id"], "vec": [np.asarray(v, dtype="<f8").tobytes() for v in batch["v"]]})

    asked = rows.filter(F.col("vec_id") % every == 0).mapInPandas(as_bytes, "query_id long, vec binary").distinct()
    return once, stored(asked.join(once.select("vec", "vid"), "vec").select("query_id", "vid"), "queries")


def _top(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k best rows of each key, ties to the smaller first id."""
    best = Window.partitionBy(key).orderBy(F.desc("score"), F.col("ids")[0])
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def exact_search(queries: list[tuple[int, bytes]], once: DataFrame, k: int) -> DataFrame:
    """(qid, vid, vec, ids, score) by scanning all vectors: for a bounded set of queries."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = vectors_of(pd.Series([v for _, v in queries]))
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        for batch in batches:
            x = vectors_of(batch["vec"])
            scores = unit @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
            top = _best(scores, np.array([i[0] for i in batch["ids"]]), k)
            for (qid, _), at, row in zip(queries, top, scores):
                yield batch.iloc[at].assign(qid=qid, score=row[at])[["qid", "vid", "vec", "ids", "score"]]

    return _top(once.mapInPandas(scan, "qid long, vid long, vec binary, ids array<long>, score double"), "qid", k)


def fit_reach(curves: Curves, once: DataFrame, asked: DataFrame, k: int, n_queries: int, target: float) -> int:
    """How many buckets to each side reach ``target`` of the true neighbours of a bounded sample
    of queries, found by scanning all vectors; measured, so it fits whatever the vectors are."""
    drawn = asked.select("vid").distinct().orderBy(F.xxhash64("vid")).limit(n_queries)
    queries = [(r[0], bytes(r[1])) for r in drawn.join(once, "vid").select("vid", "vec").collect()]
    if not queries:
        return 0
    truth = exact_search(queries, once, k + 1).filter("qid <> vid").toPandas()
    if truth.empty:
        return 0
    at = {vid: i for i, (vid, _) in enumerate(queries)}
    q = vectors_of(pd.Series([v for _, v in queries]))[truth["qid"].map(at)]
    x = vectors_of(truth["vec"])
    apart = np.min([np.abs(curves.buckets(q, c) - curves.buckets(x, c)) for c in range(len(curves.cuts))], axis=0)
    return int(np.quantile(apart, target, method="higher"))


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, n_curves: int = CURVES, target: float = TARGET,
    buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS, most_rows: int = MOST_ROWS, fit_vectors: int = FIT_VECTORS, fit_queries: int = FIT_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine that the index finds.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all others. At most
    ``fit_vectors`` vectors fit the grids and bucket borders and ``fit_queries`` queries the
    number of buckets searched to each side. Every vector is indexed. A curve has ``buckets``
    buckets, fewer where they would have less than ``bucket_rows`` rows and more where they would
    have over ``most_rows``; a task returns k + 1 rows for a query and bucket. Nearest first, ties to
    the smaller vec_id; all candidates if fewer than k. See ``distinct_vectors`` for what takes
    no part.
    """
    once, asked = distinct_vectors(vectors, every, k)
    total = once.count()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    share = min(1.0, 0.9 * fit_vectors / total)
    drawn = once.filter(F.pmod(F.xxhash64("vid"), F.lit(1 << 20)) <= int(share * (1 << 20))).limit(fit_vectors)
    n_buckets = max(1, min(buckets, total // bucket_rows), -(-total // most_rows))
    curves = fit_curves(vectors_of(drawn.select("vec").toPandas()["vec"]), n_buckets, n_curves)
    curves.reach = fit_reach(curves, once, asked, k, fit_queries, target)

    n_asked = asked.select("vid").distinct().count()
    # Queries that meet in a bucket are dealt to groups of bounded size, its vectors to each.
    dealt = max(1, -(-n_asked * (2 * curves.reach + 1) // (n_buckets * QUERY_ROWS)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = vectors_of(batch["vec"])
            for curve in range(n_curves):
                yield batch.assign(curve=curve, bucket=curves.buckets(x, curve))

    placed = "curve int, bucket int"
    base = once.mapInPandas(place, f"vid long, vec binary, ids array<long>, {placed}")
    base = base.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))
    ask = asked.select("vid").distinct().join(once.select("vid", "vec"), "vid")
    ask = ask.mapInPandas(place, f"vid long, vec binary, {placed}").withColumn("deal", F.pmod(F.xxhash64("vid"), F.lit(dealt)).cast("int"))
    ask = ask.withColumn("bucket", F.explode(F.sequence(F.greatest(F.col("bucket") - curves.reach, F.lit(0)), F.least(F.col("bucket") + curves.reach, F.lit(n_buckets - 1)))))

    def compare(data: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if data.empty or ask.empty:
            kinds = {"qid": "int64", "vid": "int64", "ids": object, "score": "float64"}
            return pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in kinds.items()})
        x, first = vectors_of(data["vec"]), np.array([i[0] for i in data["ids"]])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        out = []
        for at in range(0, len(ask), 1024):
            q = vectors_of(ask["vec"].iloc[at : at + 1024])
            top = _best(q / np.linalg.norm(q, axis=1, keepdims=True) @ unit.T, first, k + 1)
            own = np.repeat(np.arange(len(q)), top.shape[1])
            rows = data.iloc[top.ravel()]
            out.append(pd.DataFrame({
                "qid": ask["vid"].to_numpy()[at + own], "vid": rows["vid"].to_numpy(), "ids": rows["ids"].to_numpy(),
                "score": _exact(q[own], x[top.ravel()]),
            }))
        return pd.concat(out)

    keys = ["curve", "bucket", "deal"]
    found = ask.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInPandas(
        lambda a, b: compare(b, a), "qid long, vid long, ids array<long>, score double"
    )
    classes = _top(found.dropDuplicates(["qid", "vid"]), "qid", k + 1)
    each = asked.join(classes, asked["vid"] == classes["qid"]).select("query_id", F.explode("ids").alias("vec_id"), "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
