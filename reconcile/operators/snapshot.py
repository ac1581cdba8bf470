"""Catalog snapshots that may be reused instead of a fresh inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reconcile import KEY


def snapshot_rows(catalog: DataFrame, manifest: DataFrame, layout_digest: str) -> DataFrame:
    """Catalog rows of managed keys, stamped with the layout they belong to."""
    return catalog.join(manifest.select(*KEY), KEY, "left_semi").select(
        *KEY,
        "schema_name",
        "kind",
        "object_name",
        F.coalesce("parent_name", F.lit("")).alias("parent_name"),
        F.lit(layout_digest).alias("layout_digest"),
    )


def snapshot_coverage(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per database whether the snapshot covers every managed key."""
    have = rows.select(*KEY).distinct().groupBy("database_name").agg(
        F.count(F.lit(1)).alias("covered")
    )
    want = manifest.groupBy("database_name").agg(F.count(F.lit(1)).alias("object_count"))
    return want.join(have, "database_name", "left").select(
        "database_name",
        "object_count",
        F.coalesce("covered", F.lit(0)).alias("covered"),
        (F.coalesce("covered", F.lit(0)) == F.col("object_count")).alias("publish"),
    )


def publishable_rows(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Snapshot rows of fully covered databases only; a partial snapshot would
    later read as deleted objects."""
    ok = snapshot_coverage(rows, manifest).filter("publish").select("database_name")
    return rows.join(ok, "database_name", "left_semi")


def snapshot_meta(rows: DataFrame) -> DataFrame:
    """One row per database: digest, count and capture time."""
    return rows.groupBy("database_name", "layout_digest").agg(
        F.count(F.lit(1)).alias("object_count"), F.current_timestamp().alias("captured_at")
    )


def snapshot_valid(
    meta: DataFrame, manifest: DataFrame, layout_digest: str, relaxed: bool = False
) -> DataFrame:
    """Per database whether a stored snapshot may be reused: digest and count
    must match exactly, or the count alone when ``relaxed``."""
    want = manifest.groupBy("database_name").agg(F.count(F.lit(1)).alias("expected"))
    same = F.col("object_count") == F.col("expected")
    if not relaxed:
        same = same & (F.col("layout_digest") == layout_digest)
    return want.join(meta, "database_name", "left").select(
        "database_name", F.coalesce(same, F.lit(False)).alias("valid")
    )
