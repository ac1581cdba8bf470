"""Commits and the paths they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reconcile.functions import checksums as ck, paths
from reconcile.functions.text import strip
from reconcile.operators.ordered import fill_forward

SEP = "\x1f"
PREFIX = "COMMIT" + SEP


def parse_header(line):
    """struct(git_hash, git_author, git_date) of a commit header, else NULL."""
    rest = F.substring(line, len(PREFIX) + 1, 2147483647)
    p = F.split(rest, SEP, 3)
    return F.when(
        line.startswith(PREFIX) & (F.size(p) == 3) & (p[0] != ""),
        F.struct(p[0].alias("git_hash"), p[1].alias("git_author"), p[2].alias("git_date")),
    )


def attach_commit(lines: DataFrame) -> DataFrame:
    """Carry the last header forward onto path lines.

    ``lines``: file, block, line_no, line, ordered by (block, line_no) within a
    file; a block is one input split or any other bounded run of lines, so one
    huge log is filled by many tasks.
    """
    parsed = lines.select(
        "file", "block", "line_no", strip(F.col("line")).alias("line")
    ).filter(F.col("line") != "").withColumn("header", parse_header(F.col("line")))
    filled = fill_forward(parsed, ["file"], "block", "line_no", "header", "commit")
    return filled.filter(
        F.col("header").isNull() & F.col("commit").isNotNull()
    ).select(
        "file", "block", "line_no",
        paths.forward_slashes(F.col("line")).alias("path"),
        "commit.git_hash", "commit.git_author", "commit.git_date",
    )


def layout_paths(touches: DataFrame, prefix: str | None) -> DataFrame:
    """Repository paths as layout paths: the tree's own prefix removed."""
    if not prefix:
        return touches
    cut = F.substring("path", len(prefix) + 1, 2147483647)
    return touches.withColumn(
        "path", F.when(F.col("path").startswith(prefix), cut).otherwise(F.col("path"))
    )


def latest_commit_per_path(touches: DataFrame, order: list[str]) -> DataFrame:
    """First touch per path in a newest-first log; ``order`` names its columns."""
    commit = F.struct("git_hash", "git_author", "git_date")
    return touches.groupBy("path").agg(
        F.min_by(commit, F.struct(*order)).alias("c")
    ).select(F.col("path").alias("object_path"), "c.*")


def latest_commit_by_time(touches: DataFrame, newest: list[str]) -> DataFrame:
    """As above for logs that carry times instead of an order."""
    commit = F.struct("git_hash", "git_author", "git_date")
    return touches.groupBy("object_path").agg(
        F.max_by(commit, F.struct(*newest)).alias("c")
    ).select("object_path", "c.*")
