"""Plan snapshots as JSON: a map document of any size, or one object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from reconcile.operators.gate import SNAPSHOT_VERSION
from reconcile.schemas import SNAPSHOT_DOC, SNAPSHOT_OBJECT
from reconcile.session import work_path
from reconcile.sources import documents as dc

_REQUIRED = ["snapshot_key", *SNAPSHOT_OBJECT.names]
_ROW = "snapshot_key string, object_path string, planned_action string, " \
       "checksum_hex string, exists boolean"


def explode_snapshots(docs: DataFrame) -> DataFrame:
    """Long rows of documents with ``version``, ``blocked`` and a map ``objects``."""
    keep = [c for c in docs.columns if c != "objects"]
    return docs.select(*keep, F.explode("objects").alias("snapshot_key", "o")).select(
        *keep, "snapshot_key", "o.*"
    )


def _complete(rows: DataFrame) -> DataFrame:
    """``rows``; one that lacks a field of an object fails the job."""
    for c in _REQUIRED:
        missing = F.raise_error(F.lit(f"snapshot object without {c}"))
        kind = rows.schema[c].dataType
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), missing.cast(kind)).otherwise(F.col(c)))
    return rows


def read_snapshot_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT_DOC).option("mode", "FAILFAST").json(
        path, multiLine=True
    )


def _read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a document written as parts, with its ``version`` and ``blocked``."""
    lines = dc.read_lines(spark, path)
    item = F.col("line").startswith('"')
    ends = lines.filter(~item).select("line").take(3)  # the opening and the closing line
    if sorted(r.line == "}}" for r in ends) != [False, True]:
        raise ValueError("a snapshot document is incomplete")
    head = next(r.line for r in ends if r.line != "}}") + "}}"
    front = spark.range(1).select(F.from_json(F.lit(head), "version string, blocked boolean").alias("h")).first().h
    one = F.from_json(F.concat(F.lit("{"), "line", F.lit("}")), T.MapType(T.StringType(), SNAPSHOT_OBJECT), {"mode": "FAILFAST"})
    rows = lines.filter(item).select(F.explode(one).alias("snapshot_key", "o")).select("snapshot_key", "o.*")
    return rows.select(F.lit(front.version).alias("version"), F.lit(front.blocked).alias("blocked"), *rows.columns)


def read_snapshots(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    """Rows of snapshots: ``document`` (one per file, from any tool), ``parts`` (as
    :func:`write_snapshot_document` writes it) or ``lines``."""
    if layout == "parts":
        return _complete(_read_parts(spark, path))
    if layout == "lines":
        rows = spark.read.schema(_ROW).option("mode", "FAILFAST").json(f"{path}/objects")
        return _complete(rows)
    return _complete(explode_snapshots(read_snapshot_documents(spark, path)))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """version and blocked of a snapshot written as lines."""
    return spark.read.schema("version string, blocked boolean").option("mode", "FAILFAST").json(
        f"{path}/header"
    )


def write_snapshots(rows: DataFrame, path: str, blocked: bool = False) -> None:
    """One JSON object per line; no size limit."""
    spark = rows.sparkSession
    rows.select("snapshot_key", *SNAPSHOT_OBJECT.names).write.mode("overwrite").json(
        f"{path}/objects"
    )
    spark.createDataFrame(
        [(SNAPSHOT_VERSION, blocked)], "version string, blocked boolean"
    ).write.mode("overwrite").json(f"{path}/header")


def write_snapshot_document(rows: DataFrame, path: str, blocked: bool = False) -> None:
    """The map document, of any size: its files, concatenated in name order, are the JSON.

    Keys are unique; see :mod:`reconcile.sources.documents`.
    """
    spark = rows.sparkSession
    kept_path = work_path(spark, "snapshot-wire")
    name = F.regexp_extract(F.to_json(F.struct(F.col("snapshot_key").alias("k"))), r'^\{"k":(.*)\}\z', 1)
    entry = F.to_json(F.struct(*SNAPSHOT_OBJECT.names), {"ignoreNullFields": "false"})
    rows.select(
        F.lit("snapshot").alias("doc"), F.col("snapshot_key").alias("key"), F.concat(name, F.lit(":"), entry).alias("text")
    ).write.parquet(kept_path)
    kept = spark.read.parquet(kept_path)
    doc = spark.range(1).select(F.lit("snapshot").alias("doc"))
    front = F.to_json(F.struct(F.lit(SNAPSHOT_VERSION).alias("version"), F.lit(blocked).alias("blocked")))
    lines = (
        dc.lines_of(doc, 0, F.concat(F.regexp_replace(front, r"\}\z", ""), F.lit(',"objects":{')))
        .unionByName(dc.item_lines(kept, 1, kept.groupBy("doc").agg(F.min("key").alias("first"))))
        .unionByName(dc.lines_of(doc, 2, F.lit("}}")))
    )
    dc.write_documents(lines, path)
