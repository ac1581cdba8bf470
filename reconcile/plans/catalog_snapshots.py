"""Catalog snapshots that several runs publish and later runs reuse.

Rows go into a folder of their own; a numbered version file then names, for every database, the
folder in force with the layout digest and the count it was taken under.  Publishers of
different databases add to each other's version, and one that is overtaken starts over on the
newer one, so no entry is lost.  A publisher that stops before its version file leaves rows
nobody reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconcile import KEY
from reconcile.operators import scope as scp, snapshot as sn
from reconcile.sources import catalog as sc
from reconcile.sources.versions import VersionLog

META = "database_name string, layout_digest string, object_count long, folder string"


def manifest_digest(manifest: DataFrame) -> str:
    """Digest of the layout the manifest was read from."""
    return scp.layout_digest(manifest.select(F.col("object_path").alias("path"))).first().layout_digest


def publish(catalog: DataFrame, manifest: DataFrame, path: str, digest: str | None = None) -> list[str]:
    """Publish the databases whose catalog covers every managed key; their names.

    Databases that aren't covered keep the snapshot they have.
    """
    spark = catalog.sparkSession
    digest = digest or manifest_digest(manifest)
    rows = sn.publishable_rows(sn.snapshot_rows(catalog, manifest, digest), manifest)
    folder = sc.write_snapshot_rows(rows, path)
    # One row per database, as in the version file itself.
    counts = spark.read.parquet(f"{path}/{folder}").groupBy("database_name").agg(
        F.count_distinct("normalized_key").alias("n")
    ).collect()
    mine = {r.database_name: {"folder": folder, "digest": digest, "objects": r.n} for r in counts}
    if not mine:
        return []
    log = VersionLog(spark, path)

    def prepare(last: int | None) -> dict:
        before = {} if last is None else log.read(last)["databases"]
        return {"databases": before | mine}

    log.publish(prepare)
    return sorted(mine)


def published(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and metadata (digest and count per database) of the version in force."""
    log = VersionLog(spark, path)
    last = log.latest()
    databases = {} if last is None else log.read(last)["databases"]
    meta = spark.createDataFrame(
        [(d, e["digest"], e["objects"], e["folder"]) for d, e in sorted(databases.items())], META
    )
    folders = sorted({e["folder"] for e in databases.values()})
    own = None
    for f in folders:
        part = spark.read.parquet(f"{path}/{f}").withColumn("folder", F.lit(f))
        own = part if own is None else own.unionByName(part)
    if own is None:
        empty = ", ".join(f"{c} string" for c in (*KEY, "schema_name", "kind", "object_name", "parent_name", "layout_digest"))
        return spark.createDataFrame([], empty), meta.drop("folder")
    rows = own.join(meta.select("database_name", "folder"), ["database_name", "folder"], "left_semi")
    return rows.drop("folder"), meta.drop("folder")


def reuse(spark: SparkSession, path: str, manifest: DataFrame, relaxed: bool = False) -> DataFrame:
    """Published rows of the databases whose snapshot still fits the manifest: digest and
    count, or the count alone when ``relaxed``.  Other databases must be inspected."""
    rows, meta = published(spark, path)
    valid = sn.snapshot_valid(meta, manifest, manifest_digest(manifest), relaxed)
    # Rows that don't add up to their count are damaged and not reused.
    whole = rows.groupBy("database_name").agg(F.count_distinct("normalized_key").alias("object_count")).join(
        meta, ["database_name", "object_count"], "left_semi"
    )
    return rows.join(valid.filter("valid"), "database_name", "left_semi").join(whole, "database_name", "left_semi")
