"""The file catalog as a Parquet table that is changed in place, and a bridge from ids to its assets.

Assets lie in folders by a hash of their id, so merging or deleting reads and writes only the
folders of the ids concerned, by Spark's dynamic partition overwrite. The bridge is the lineage ids
exploded to (kind, id, asset_id) and sorted by id: a selective search reads few of its files, and
then only the catalog folders of the assets it found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import catalog
from tideline.operators.lineage import check_stage
from tideline.session import staged
from tideline.sinks.lake import write_partitions

# Folders of a catalog. All uses of one catalog must agree on the number; some ten thousand
# assets a folder are a good size, so large catalogs want thousands.
BUCKETS = 16


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("asset_id"), F.lit(buckets)).cast("int")


def _table(root: str, buckets: int) -> str:
    return f"{root}/of-{buckets}"


def read_catalog(spark: SparkSession, root: str, buckets: int = BUCKETS) -> DataFrame | None:
    """The catalog with its ``bucket`` column; None before the first merge.

    It shows the files of now: a plan that is run after the next merge needs a new read, or ``staged`` rows.
    """
    try:
        return spark.read.parquet(_table(root, buckets))
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def upsert_catalog(incoming: DataFrame, root: str, buckets: int = BUCKETS) -> list[int]:
    """Merge rows into the catalog (see ``operators.catalog.upsert``); returns the folders written.

    Incoming rows are staged once, so they are made once; the merged folders are staged too, before
    they replace the old ones. Doing it again, also after a failure, changes nothing.
    """
    spark = incoming.sparkSession
    new = staged(incoming.withColumn("bucket", bucket_of(buckets)), "incoming")
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
    if not touched:
        return touched
    known = read_catalog(spark, root, buckets)
    rows = new.drop("bucket")
    before = rows.limit(0) if known is None else known.filter(F.col("bucket").isin(touched)).select(*rows.columns)
    merged = staged(catalog.upsert(before, rows).withColumn("bucket", bucket_of(buckets)), "merged")
    write_partitions(merged, _table(root, buckets), ["bucket"])
    return touched


def delete_from_catalog(spark: SparkSession, root: str, prefix: str, buckets: int = BUCKETS) -> int:
    """Remove the rows below a path prefix, writing only folders that hold some; how many went."""
    known = read_catalog(spark, root, buckets)
    if known is None:
        return 0
    gone = {r["bucket"]: r["n"] for r in known.filter(catalog.below(prefix)).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    if not gone:
        return 0
    left = staged(catalog.delete(known.filter(F.col("bucket").isin(sorted(gone))), prefix), "left")
    full = {r[0] for r in left.select("bucket").distinct().collect()}
    write_partitions(left, _table(root, buckets), ["bucket"])
    jvm = spark.sparkContext._jvm
    for bucket in gone.keys() - full:
        # An overwrite by partition leaves folders alone that have no rows any more.
        path = jvm.org.apache.hadoop.fs.Path(f"{_table(root, buckets)}/bucket={bucket}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return sum(gone.values())


KINDS = {"scope": "scope_ids", "schedule": "schedule_ids", "task": "task_ids", "tag": "tags"}


def write_bridge(assets: DataFrame, path: str, files: int | None = None) -> None:
    """(kind, id, asset_id) of every id of every asset, a folder per kind, in files of even size sorted by id.

    A hot id fills several files, because they are cut by (id, asset_id). Null ids have no row.
    """
    def members_of(kind: str, column: str) -> Column:
        given = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(given, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("id")))

    members = F.concat(*[members_of(kind, column) for kind, column in KINDS.items() if column in assets.columns])
    rows = assets.select("asset_id", F.explode(members).alias("m")).select("m.kind", "m.id", "asset_id").filter("id is not null")
    order = ["kind", "id", "asset_id"]
    once = rows.distinct()
    ranged = once.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").partitionBy("kind").parquet(path)


def _having(bridge: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """(asset_id, kinds): the assets that have any of the wanted ids, and of which kinds."""
    asked = None
    for kind, ids_ in wanted.items():
        term = (F.col("kind") == kind) & F.col("id").isin(list(ids_))
        asked = term if asked is None else asked | term
    return bridge.filter(asked).groupBy("asset_id").agg(F.collect_set("kind").alias("kinds"))


def _of(assets: DataFrame, found: DataFrame, stage: str | None, buckets: int) -> DataFrame:
    rows = assets if stage is None else assets.filter(F.col("stage") == check_stage(stage))
    if "bucket" not in assets.columns:
        return rows.join(found.select("asset_id"), "asset_id", "left_semi")
    # With the folder in the join Spark skips the folders that no found asset lies in.
    return rows.join(found.select(bucket_of(buckets).alias("bucket"), "asset_id"), ["bucket", "asset_id"], "left_semi").drop("bucket")


def lineage_by_bridge(
    bridge: DataFrame, assets: DataFrame, stage: str, scope_ids: Sequence[str] = (), schedule_ids: Sequence[str] = (),
    tags: Sequence[str] = (), buckets: int = BUCKETS,
) -> DataFrame:
    """What ``operators.catalog.lineage_search`` finds, by the bridge in place of a scan."""
    both = {k: v for k, v in (("scope", scope_ids), ("schedule", schedule_ids)) if v}
    wanted = both | ({"tag": tags} if tags else {})
    if not wanted:
        return assets.filter(F.col("stage") == check_stage(stage)).drop("bucket")
    has = lambda kind: F.array_contains("kinds", kind)
    match = has("tag") if tags else F.lit(False)
    if both:
        terms = [has(kind) for kind in both]
        match = match | (terms[0] & terms[1] if len(terms) == 2 else terms[0])
    return _of(assets, _having(bridge, wanted).filter(match), stage, buckets)


def catalog_by_bridge(
    bridge: DataFrame, assets: DataFrame, stage: str | None = None, buckets: int = BUCKETS, **ids_given: str | None
) -> DataFrame:
    """Assets of a stage that have every given ``scope_id``, ``schedule_id`` and ``task_id``."""
    wanted = {name.removesuffix("_id"): [value] for name, value in ids_given.items() if value}
    if not wanted:
        return (assets if stage is None else assets.filter(F.col("stage") == stage)).drop("bucket")
    return _of(assets, _having(bridge, wanted).filter(F.size("kinds") == len(wanted)), stage, buckets)
