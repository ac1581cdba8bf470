"""Fail-closed checks; each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reconcile import KEY
from reconcile.functions import checksums as ck, kinds, paths


def duplicate_keys(manifest: DataFrame) -> DataFrame:
    """Keys that occur more than once in a database, ignoring case."""
    key = F.lower("normalized_key").alias("normalized_key")
    return manifest.groupBy("database_name", key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("object_path").alias("first_path"),
        F.max("object_path").alias("last_path"),
    ).filter("n > 1")


def duplicate_ordinals(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy(*KEY, "ordinal").agg(
        F.count(F.lit(1)).alias("n")
    ).filter("n > 1")


def ambiguous_children(catalog: DataFrame) -> DataFrame:
    """Index keys that exist under different parents.  min <> max finds two
    distinct parents without a distinct aggregate."""
    parent = F.coalesce("parent_name", F.lit(""))
    return (
        catalog.filter(F.col("kind") == "indexes")
        .groupBy(*KEY)
        .agg(F.min(parent).alias("first_parent"), F.max(parent).alias("other_parent"))
        .filter("first_parent <> other_parent")
    )


def layout_violations(files: DataFrame) -> DataFrame:
    """Nested object scripts (error) and unknown kind folders (warning)."""
    parts = F.split("path", "/")
    folder = F.try_element_at(parts, F.lit(-2))
    known = folder.isin(kinds.MANAGED_KINDS)
    candidate = ~F.contains(F.col("path"), F.lit("/tables/_migrations/")) & ~paths.is_check_path(
        F.col("path")
    )
    issue = (
        F.when(candidate & (F.size(parts) > 4) & known, "nested_object_path")
        .when(candidate & (F.size(parts) == 4) & ~known, "unknown_kind_folder")
    )
    severity = F.when(F.col("issue") == "nested_object_path", "error").otherwise("warning")
    return (
        files.withColumn("issue", issue)
        .filter(F.col("issue").isNotNull())
        .select("path", "issue", severity.alias("severity"))
    )


def invalid_components(files: DataFrame) -> DataFrame:
    """Paths with a level that is no safe name.

    Of object paths the database, schema and name are looked at, of anything in the place
    of a change script the schema, table and file name, whether or not the file is one.
    """
    p = F.split("path", "/")
    level = lambda i: paths.valid_component(F.try_element_at(p, F.lit(i)))
    name = paths.valid_component(paths.strip_sql_ext(F.try_element_at(p, F.lit(4))))
    script = (
        (F.size(p) >= 6)
        & (F.try_element_at(p, F.lit(-4)) == "tables")
        & (F.try_element_at(p, F.lit(-3)) == "_migrations")
    )
    bad = F.when(script, ~(level(-5) & level(-2) & level(-1))).when(
        paths.classify_path(F.col("path")) == "object", ~(level(1) & level(2) & name)
    )
    return files.filter(bad).select("path")


def overlong_paths(files: DataFrame, limit: int = paths.MAX_KEY_UNITS) -> DataFrame:
    """Paths that do not fit the audit key, counted in UTF-16 units."""
    units = paths.utf16_units(F.col("path"))
    return files.select("path", units.alias("units")).filter(F.col("units") > limit)


def orphan_transitions(transitions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Change scripts whose table is not managed in the same database."""
    tables = manifest.filter(F.col("kind") == "tables").select(*KEY)
    return transitions.join(tables, KEY, "left_anti")


def changed_since_scan(manifest: DataFrame, rescan: DataFrame) -> DataFrame:
    """Scanned scripts whose bytes differ now, or which are gone."""
    now = rescan.select(
        F.col("object_path"), ck.content_checksum(F.col("content")).alias("current")
    )
    joined = manifest.select(*KEY, "object_path", "checksum").join(now, "object_path", "left")
    message = F.when(
        F.col("current").isNull(),
        F.format_string("%s: script not found", F.col("normalized_key")),
    ).otherwise(
        F.format_string("%s: file changed after scan", F.col("normalized_key"))
    )
    return joined.filter(
        F.col("current").isNull() | (F.col("current") != F.col("checksum"))
    ).select(*KEY, "object_path", message.alias("message"))


def missing_databases(manifest: DataFrame, databases: DataFrame) -> DataFrame:
    """Databases the manifest names that the server does not have."""
    return manifest.select("database_name").distinct().join(
        databases.select("database_name"), "database_name", "left_anti"
    )
