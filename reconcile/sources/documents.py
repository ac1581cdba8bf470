"""JSON documents of any size, assembled from ordered lines.

A document is a folder of text files whose concatenation in name order is the JSON:
opening lines, one line per item, closing lines.  Lines are range-ordered, so many
tasks write one document and none holds it; a reader takes the items line by line,
again in many tasks.  Folders are named by document, ``doc=<name>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def item_lines(items: DataFrame, section: int, first: DataFrame) -> DataFrame:
    """Lines of a section's items (``doc``, ``key``, ``text``), separated by commas.

    ``first`` holds the smallest key of the section per document, as column ``first``.
    Keys are unique within a document.
    """
    rows = items.select("doc", "key", "text").join(first.select("doc", "first"), "doc", "left")
    comma = F.when(F.col("key") == F.col("first"), "").otherwise(",")
    return rows.select("doc", F.lit(section).alias("section"), "key", F.concat(comma, "text").alias("line"))


def lines_of(docs: DataFrame, section: int, line: Column) -> DataFrame:
    """One line per document, none where ``line`` is NULL."""
    out = docs.select("doc", F.lit(section).alias("section"), F.lit("").alias("key"), line.alias("line"))
    return out.filter(F.col("line").isNotNull())


def write_documents(lines: DataFrame, path: str) -> None:
    """Write lines (``doc``, ``section``, ``key``, ``line``) as documents below ``path``.

    Ranges are cut by a pass over ``lines``, so these should come from tables.
    """
    order = ["doc", "section", "key"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc", "line"
    ).write.mode("overwrite").partitionBy("doc").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``doc`` and ``line`` of written documents, items without their leading comma."""
    rows = spark.read.schema("value string, doc string").text(path)
    return rows.select("doc", F.regexp_replace("value", "^,", "").alias("line"))
