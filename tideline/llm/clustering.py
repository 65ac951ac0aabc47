"""Centroid clustering of integer vectors with zone maps along a space-filling curve.

Vectors are ordered along a Hilbert curve and cut into blocks; each block keeps the box of its smallest and
largest components. The distance from a centroid to a box bounds its distance to every vector in
it, so a block compares its vectors only with centroids that could be nearest to one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.ann import hilbert
from tideline.llm.common import stored

K, ROUNDS, SEED = 8, 10, 3
SIZE, SCALE = 64, 1024
DIMS, BITS = 6, 8
BLOCK = 256
# Components below this leave room for the squares of SIZE differences in 63 bits.
TOO_LARGE = 1 << 27


def whole_vectors(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, as whole numbers floor(scale * x).

    Those have exactly ``size`` components, none null or non-finite. A component of 2**27 and more
    after scaling raises an error: its distances would not fit a long.
    """
    x = F.col("embedding").cast("array<double>")
    fits = (F.size(x) == size) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = F.transform(x, lambda e: F.floor(F.when(F.abs(e * scale) < TOO_LARGE, e * scale).otherwise(
        F.raise_error(F.lit("a component is too large for distances in a long")).cast("double"))))
    return vectors.filter(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.cast("array<int>").alias("v"))


def first_centroids(whole: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``, in that order, as rows.

    A null vec_id is written as an empty text; rows of one hash are ordered by their components.
    """
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = whole.select("v", F.sha2(text, 256).alias("h")).orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def zone_blocks(whole: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """The vectors in blocks along the curve, stored: ids (null where ``known`` is false), their
    components and the box, all as little-endian bytes of int64, bool and int32.

    The curve runs over a few fixed random directions between the smallest and largest projections
    of all vectors. Equal places are parted by a hash of the row, so copies of one vector do
    not fill one task.
    """
    turn = np.linalg.qr(np.random.default_rng(size).standard_normal((size, min(DIMS, size))))[0]
    dims = turn.shape[1]

    def matrix(batch: pd.DataFrame) -> np.ndarray:
        return np.stack(batch["v"].to_numpy()).astype(np.int64)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = np.full(dims, np.inf), np.full(dims, -np.inf)
        for batch in batches:
            if len(batch):
                seen = matrix(batch) @ turn
                low, high = np.minimum(low, seen.min(0)), np.maximum(high, seen.max(0))
        if np.isfinite(low).all():
            yield pd.DataFrame({"dim": range(dims), "low": low, "high": high})

    found = whole.mapInPandas(reach, "dim int, low double, high double")
    ends = {r["dim"]: (r["low"], r["high"]) for r in found.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    low = np.array([ends.get(i, (0.0, 0.0))[0] for i in range(dims)])
    width = np.maximum(np.array([ends.get(i, (0.0, 0.0))[1] for i in range(dims)]) - low, 1e-9)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = matrix(batch)
                cells = ((x @ turn - low) / width * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1)
                packed = [r.tobytes() for r in x.astype("<i4")]
                yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "vec": packed, "curve": hilbert(cells, BITS)})

    placed = whole.mapInPandas(place, "vec_id long, vec binary, curve long")
    order = ["curve", "salt"]
    along = placed.withColumn("salt", F.xxhash64("vec_id", "vec")).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                x = np.frombuffer(b"".join(part["vec"]), "<i4").reshape(len(part), -1)
                ids = part["vec_id"].astype("Int64")
                out.append((
                    len(part), ids.fillna(0).to_numpy("<i8").tobytes(), ids.notna().to_numpy(bool).tobytes(), x.tobytes(),
                    x.min(0).tobytes(), x.max(0).tobytes(),
                ))
            yield pd.DataFrame(out, columns=["n", "ids", "known", "vecs", "low", "high"])

    return stored(
        along.select("vec_id", "vec").mapInPandas(cut, "n long, ids binary, known binary, vecs binary, low binary, high binary"), "blocks"
    )


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector in the box.

    A centroid farther from the box's nearest corner than another is from its farthest one is
    out. Ties stay in, so the smallest number can win them.
    """
    under, over = low - centroids, centroids - high
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(1)
    most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(1)
    return np.flatnonzero(least <= most.min())


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of the nearest centroid, the smaller of equals, and the squared distance."""
    d = np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def assign_block(row, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's vectors with the number of their centroid and the squared distance to it."""
    x = np.frombuffer(row.vecs, "<i4").reshape(row.n, -1).astype(np.int64)
    able = candidates(np.frombuffer(row.low, "<i4").astype(np.int64), np.frombuffer(row.high, "<i4").astype(np.int64), centroids)
    best, distance = nearest(x, centroids[able])
    return x, able[best], distance


def next_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every vector to its nearest centroid, then the floor of the exact means.

    Tasks send one row per cluster; sums are decimals. Only the means reach the driver.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for row in batch.itertuples(index=False):
                x, cluster, _ = assign_block(row, centroids)
                order = np.argsort(cluster, kind="stable")
                present, first = np.unique(cluster[order], return_index=True)
                sums[present] += np.add.reduceat(x[order], first, axis=0)
                counts += np.bincount(cluster, minlength=len(centroids))
        for cluster in np.flatnonzero(counts):
            yield pd.DataFrame({"cluster": [int(cluster)], "n": [int(counts[cluster])], "sums": [sums[cluster]]})

    parts = blocks.mapInPandas(add, "cluster int, n long, sums array<long>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s")
    )
    moved = centroids.copy()
    for r in sums.collect():
        moved[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    return moved


def cluster(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector.

    Vectors that take part: see ``whole_vectors``; ids may be null or repeat, every row counts. Centroids
    start as in ``first_centroids`` (fewer than ``k`` vectors: as many as there are). A round assigns each
    vector to the nearest centroid, ties to the smaller number, and moves every centroid that has
    vectors to the floor of their mean. After the last round vectors are assigned once more;
    distances are squared. No vectors: no rows.
    """
    whole = whole_vectors(vectors, size, scale)
    centroids = first_centroids(whole, k, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return whole.sparkSession.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = zone_blocks(whole, size)
    for _ in range(rounds):
        moved = next_centroids(blocks, centroids)
        if (moved == centroids).all():
            break
        centroids = moved

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                _, own, distance = assign_block(row, centroids)
                ids = pd.array(np.frombuffer(row.ids, "<i8"), dtype="Int64")
                ids[~np.frombuffer(row.known, bool)] = pd.NA
                yield pd.DataFrame({"vec_id": ids, "cluster": own.astype(np.int32), "distance": distance})

    assigned = stored(blocks.mapInPandas(last, schema), "assigned")
    of = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    named = [
        (i, int(of[i]), int(sum(of.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(centroids) if i in of
    ]
    # At most k rows.
    facts = whole.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
