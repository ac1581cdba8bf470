"""Commit logs as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconcile.operators.provenance import attach_commit


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their position: ``file``, ``block`` (split start), ``line_no``.

    A split is read by one task front to back, so the row id orders its lines;
    big logs are read in many splits.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, path) rows of ``COMMIT`` headers followed by path lines."""
    return attach_commit(read_log_lines(spark, path))
