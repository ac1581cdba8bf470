"""Script trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconcile.functions import checksums as ck, paths

SQL_GLOB = "*.[sS][qQ][lL]"


def _hidden_globs(spark: SparkSession, root: str) -> list[str]:
    """Globs for folders starting with ``_`` or ``.``, which Spark's listing skips
    below a root but accepts as roots.  Only globs that match are returned; the
    walk ends at the first depth without any entry."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    level = root.rstrip("/")

    def matches(glob: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(glob)
        return bool(path.getFileSystem(conf).globStatus(path))

    while matches(f"{level}/*"):
        if matches(f"{level}/[_.]*"):
            out.append(f"{level}/[_.]*")
        level += "/*"
    return out


def scan_tree(spark: SparkSession, root: str, glob: str = SQL_GLOB) -> DataFrame:
    """``path`` (relative, ``/``), ``content``, ``length`` of files below ``root``.

    Folders named with a leading ``_`` or ``.`` are read at every depth. Files
    named so are not: Spark's listing leaves them out even when given as roots.
    Content is read only where a query uses it.  Links are followed by the
    file system's listing.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load([root, *_hidden_globs(spark, root)])
    )
    # The absolute form may carry a scheme, and one or three slashes after it.
    base = root.split("://", 1)[-1].strip("/") + "/"
    start = F.locate(base, F.col("path")) + F.lit(len(base))
    rel = F.substring("path", start, F.lit(2147483647))
    return files.select(rel.alias("path"), "content", "length")


def classify_paths(files: DataFrame) -> DataFrame:
    return files.withColumn("script_kind", paths.classify_path(F.col("path")))


def manifest_of(files: DataFrame) -> DataFrame:
    """Manifest rows of the object scripts in a scanned tree.  ``content`` is NULL
    for a script that is not valid UTF-8; its checksum covers the raw bytes."""
    p = F.split("path", "/")
    name = paths.strip_sql_ext(p[3])
    return classify_paths(files).filter("script_kind = 'object'").select(
        p[0].alias("database_name"),
        paths.normalized_key(p[1], p[2], name).alias("normalized_key"),
        F.lower(p[1]).alias("schema_name"),
        p[2].alias("kind"),
        F.lower(name).alias("object_name"),
        F.col("path").alias("object_path"),
        ck.content_checksum_bytes(F.col("content")).alias("checksum"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("content"),
    )


def transitions_of(files: DataFrame, marker: str = paths.SCAFFOLD_MARK) -> DataFrame:
    """Authored change scripts in a scanned tree; scaffolds are left out."""
    t = paths.parse_transition(F.col("path"))
    scaffold = paths.is_scaffold(F.decode("content", "ISO-8859-1"), marker)
    return files.withColumn("t", t).filter(F.col("t").isNotNull() & ~scaffold).select(
        "t.database_name", "t.normalized_key", "t.ordinal", "path",
        ck.content_checksum_bytes(F.col("content")).alias("checksum"),
    )


def discover_databases(files: DataFrame) -> DataFrame:
    """Top-level folders that hold a sub-folder and are not hidden."""
    p = F.split("path", "/")
    return files.filter((F.size(p) >= 3) & ~p[0].startswith(".")).select(
        p[0].alias("database_name")
    ).distinct()


def require_databases(files: DataFrame) -> DataFrame:
    found = discover_databases(files)
    if found.isEmpty():
        raise ValueError("no database folders found")
    return found


