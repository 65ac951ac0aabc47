"""A vector index in lists: k-means centroids, a folder per list, and only the lists that matter are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.insights import top_rows
from tideline.operators.similarity import _nearest, _unit
from tideline.session import scratch_dir

# Angles and similarities computed twice may differ by as much.
SLACK = 1e-7


def usable_vectors(rows: DataFrame, width: int, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector has ``width`` finite components that are not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter((F.size(embedding) == width) & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda x: x != 0))


def vector_width(rows: DataFrame, embedding: str = "embedding") -> int:
    """The commonest number of components (the smaller of equally common ones); 0 without vectors."""
    sizes = rows.filter(F.size(embedding) > 0).groupBy(F.size(embedding).alias("width")).count()
    first = sizes.orderBy(F.desc("count"), "width").first()
    return first[0] if first else 0


def train(vectors: DataFrame, n_lists: int, rounds: int = 8, per_list: int = 256) -> np.ndarray:
    """At most ``n_lists`` unit centroids, one per row, of (id, embedding) rows by spherical k-means.

    Fitted on about ``per_list * n_lists`` rows, drawn by a hash of the id. Each round adds up one
    vector per list and task, and Spark sums these, so only centroids reach the driver. Rounds
    start from the different vectors with the smallest hashes; a list that gets no row keeps its
    centroid. No usable vectors: no centroids.
    """
    spark, width = vectors.sparkSession, vector_width(vectors)
    rows = usable_vectors(vectors, width).select("id", "embedding")
    share = min(1.0, per_list * n_lists / max(1, rows.count()))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    path = scratch_dir(spark, "index-sample")
    rows.filter(place < int(share * (1 << 30))).withColumn("place", place).write.parquet(path)
    sample = spark.read.parquet(path)
    first = sample.groupBy("embedding").agg(F.min(F.struct("place", "id")).alias("at")).orderBy("at").limit(n_lists)
    starts = first.select("embedding").collect()
    if not starts:
        return np.zeros((0, width))
    centroids = _unit(pd.Series([r[0] for r in starts]))

    for _ in range(rounds):
        now = centroids

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(now)
            for batch in batches:
                unit = _unit(batch["embedding"])
                np.add.at(total, (unit @ now.T).argmax(axis=1), unit)
            met = np.flatnonzero(total.any(axis=1))
            if len(met):
                yield pd.DataFrame({"list": met, "total": pd.Series(list(total[met]), dtype=object)})

        parts = sample.select("embedding").mapInPandas(sums, "list int, total array<double>")
        added = parts.select("list", F.posexplode("total").alias("pos", "x")).groupBy("list", "pos").agg(F.sum("x").alias("x"))
        moved = np.zeros_like(now)
        for r in added.collect():
            moved[r["list"], r["pos"]] = r["x"]
        lengths = np.linalg.norm(moved, axis=1, keepdims=True)
        centroids = np.where(lengths > SLACK, moved / np.maximum(lengths, SLACK), now)
    return centroids


def write_index(rows: DataFrame, path: str, centroids: np.ndarray, cell_rows: int = 20_000) -> None:
    """``rows`` (id, embedding and any others) below ``path``, a folder per list of the nearest centroid.

    A list of more than about ``cell_rows`` rows is cut into cells by a hash of the id, so that a
    list that a third of all rows fall in is written and searched by many tasks. ``path/lists`` has a
    row per list: its centroid, rows, cells and radius (the widest angle to its centroid). Rows
    without a usable vector are not kept; the columns ``list``, ``cell`` and ``angle`` are replaced.
    """
    spark, width = rows.sparkSession, centroids.shape[1]

    @F.pandas_udf("list int, angle double")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        likeness = _unit(vectors) @ centroids.T
        best = likeness.argmax(axis=1)
        nearest = likeness[np.arange(len(best)), best]
        return pd.DataFrame({"list": best.astype(np.int32), "angle": np.arccos(np.clip(nearest, -1, 1))})

    own = [c for c in rows.columns if c not in ("list", "cell", "angle")]
    placed = usable_vectors(rows.select(*own), width) if len(centroids) else rows.select(*own).limit(0)
    placed = placed.withColumn("__at", assign("embedding")).select(*own, "__at.list", "__at.angle")
    staged = scratch_dir(spark, "index-rows")
    placed.write.parquet(staged)
    kept = spark.read.schema(placed.schema).parquet(staged)
    found = {r["list"]: r for r in kept.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
    lists = [
        (i, [float(x) for x in centroids[i]], found[i]["n"], -(-found[i]["n"] // cell_rows), float(found[i]["radius"])) for i in sorted(found)
    ]
    known = spark.createDataFrame(lists, "list int, centroid array<double>, n long, cells long, radius double")
    # One row per list.
    dealt = kept.join(F.broadcast(known.select("list", "cells")), "list").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    dealt.select(*own, "list", "cell").repartition("list", "cell").write.partitionBy("list", "cell").parquet(f"{path}/rows")
    known.coalesce(1).write.parquet(f"{path}/lists")


def search(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int,
    probes: int = 8,
    exact: bool = False,
    prefilter: Column | None = None,
    block_queries: int = 1024,
) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` rows nearest to each (query_id, embedding) by cosine.

    Each query looks at its ``probes`` nearest lists; only their folders are read. With ``exact`` it then
    looks at all other lists that could hold a nearer row: no row of a list is closer than the
    angle to its centroid less the list's radius, so the result is that of a scan. ``prefilter`` is
    a condition on the rows' other columns, pushed to the scan. Equal similarities rank by id.
    """
    lists = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    kind = queries.schema["query_id"].dataType.simpleString()
    width = len(lists[0]["centroid"]) if lists else 0
    asked = usable_vectors(queries.select("query_id", "embedding"), width).withColumnRenamed("embedding", "query")
    asked = asked.withColumn("floor", F.lit(None).cast("double"))
    found = _looked_up(spark, path, lists, asked, k, probes, False, prefilter, block_queries, kind)
    if not exact or len(lists) <= probes:
        return top_rows(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k)
    kept = scratch_dir(spark, "index-found")
    top_rows(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k).write.parquet(kept)
    first = spark.read.parquet(kept)
    floors = first.filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("floor"))
    asked = asked.drop("floor").join(floors, "query_id", "left")
    more = _looked_up(spark, path, lists, asked, k, probes, True, prefilter, block_queries, kind)
    return top_rows(first.drop("rank").unionByName(more), ["query_id"], [F.desc("similarity"), F.asc("id")], k)


def _looked_up(spark, path, lists, asked, k, probes, rest, prefilter, block_queries, kind) -> DataFrame:
    """Best rows per query and cell of the first ``probes`` lists, or of the rest within the bound."""
    centroids = np.array([r["centroid"] for r in lists]) if lists else np.zeros((0, 0))
    numbers = np.array([r["list"] for r in lists], dtype=np.int32)
    radius = np.array([r["radius"] for r in lists])

    @F.pandas_udf("array<int>")
    def to_visit(vectors: pd.Series, floors: pd.Series) -> pd.Series:
        likeness = _unit(vectors) @ centroids.T
        order = np.argsort(-likeness, axis=1, kind="stable")
        if not rest:
            return pd.Series(list(numbers[order[:, :probes]]), dtype=object)
        angle = np.arccos(np.clip(likeness, -1, 1))
        best = np.cos(np.maximum(0, angle - radius - SLACK))
        least = floors.to_numpy(dtype=np.float64, na_value=-np.inf)[:, None]
        open_ = ~(best + SLACK < least)
        np.put_along_axis(open_, order[:, :probes], False, axis=1)
        return pd.Series([numbers[row] for row in open_], dtype=object)

    if not lists:
        return spark.createDataFrame([], f"query_id {kind}, id long, similarity double")
    visits = asked.select("query_id", "query", F.explode(to_visit("query", "floor")).alias("list"))
    kept = scratch_dir(spark, "index-visits")
    visits.write.parquet(kept)
    visits = spark.read.schema(visits.schema).parquet(kept)
    cells = {r["list"]: r["cells"] for r in lists}
    # One row per list.
    wanted = [(r["list"], cells[r["list"]], -(-r["n"] // block_queries)) for r in visits.groupBy("list").agg(F.count("*").alias("n")).collect()]
    held = spark.read.parquet(f"{path}/rows").filter(F.col("list").isin([w[0] for w in wanted]))
    if prefilter is not None:
        held = held.filter(prefilter)
    schema = f"query_id {kind}, id {held.schema['id'].dataType.simpleString()}, similarity double"
    plan = F.broadcast(spark.createDataFrame(wanted, "list int, cells long, blocks long"))
    asking = (
        visits.join(plan, "list")
        .withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
        .select("query_id", "query", "list", F.explode(F.sequence(F.lit(0), F.col("cells").cast("int") - 1)).alias("cell"), "block")
    )
    holding = held.join(plan, "list").select(
        "id", F.col("embedding").alias("passage"), "list", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    )
    at = ["list", "cell", "block"]
    return asking.groupBy(*at).cogroup(holding.groupBy(*at)).applyInPandas(lambda q, p: _nearest(q, p, k), schema)
