"""Catalog tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconcile.functions import kinds, paths
from reconcile.schemas import CATALOG, conform


def read_catalog(
    spark: SparkSession, path: str | None = None, jdbc: dict[str, str] | None = None
) -> DataFrame:
    """Catalog rows from Parquet, or from a server through Spark's JDBC source.

    For JDBC pass its options, with ``partitionColumn`` and bounds for a
    parallel read.
    """
    if (path is None) == (jdbc is None):
        raise ValueError("give either a path or JDBC options")
    raw = spark.read.parquet(path) if path else spark.read.format("jdbc").options(**jdbc).load()
    return normalize_catalog(raw)


def normalize_catalog(raw: DataFrame) -> DataFrame:
    """Lower-cased rows in the catalog schema, kinds from type labels, keyed."""
    df = raw
    if "kind" not in df.columns and "type_desc" in df.columns:
        df = df.withColumn("kind", kinds.kind_from_type_desc(F.col("type_desc")))
    if "row_kind" not in df.columns:
        df = df.withColumn("row_kind", F.lit("object"))
    df = conform(df, CATALOG)
    low = {c: F.lower(F.coalesce(c, F.lit("")))
           for c in ("schema_name", "kind", "object_name", "parent_name")}
    key = paths.normalized_key(F.col("schema_name"), F.col("kind"), F.col("object_name"))
    return df.withColumns(low).withColumn("normalized_key", key)


def write_snapshot_rows(rows: DataFrame, path: str) -> str:
    """Snapshot rows in a new folder below ``path``; returns its name."""
    folder = f"rows-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    return folder


def write_snapshot_meta(meta: DataFrame, path: str, folder: str) -> None:
    meta.withColumn("folder", F.lit(folder)).write.mode("overwrite").parquet(f"{path}/meta")


def write_snapshot(rows: DataFrame, meta: DataFrame, path: str) -> None:
    """Publish snapshot rows in a folder of their own, then the metadata that names it.

    Rows are never overwritten, so a run that dies in between leaves the earlier
    snapshot in force. Folders of earlier versions stay for readers that use them.
    """
    write_snapshot_meta(meta, path, write_snapshot_rows(rows, path))


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and metadata of the version in force. Metadata is left out where the
    rows of a database don't add up to its count."""
    meta = spark.read.parquet(f"{path}/meta")
    named = meta.select("folder").first()  # one folder per version
    if named is None:
        raise ValueError("the snapshot holds no database")
    rows = spark.read.parquet(f"{path}/{named.folder}")
    counts = rows.groupBy("database_name").agg(F.count(F.lit(1)).alias("object_count"))
    return rows, meta.drop("folder").join(counts, ["database_name", "object_count"], "left_semi")
