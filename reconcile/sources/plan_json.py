"""Plans as JSON: one nested document per database, or one object per line.

Both are written from one evaluation of the plan, kept in a table of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconcile.functions.scenarios import ACTIONS
from reconcile.schemas import PLAN_DOC, PLAN_OBJECT
from reconcile.session import work_path
from reconcile.sources import documents as dc

# JSON name of every plan object field, in wire order.
WIRE = {
    "normalized_key": "normalizedKey", "object_path": "objectPath",
    "schema_name": "schemaName", "kind": "kind", "object_name": "objectName",
    "database_name": "databaseName", "parent_name": "parentName",
    "transition_paths": "transitionPaths", "git_hash": "gitHash",
    "git_author": "gitAuthor", "git_date": "gitDate", "checksum": "checksum",
    "planned_action": "plannedAction", "exists": "exists",
}
_OMIT_BLANK = ["database_name", "parent_name"]
# A plan object without one of these is damaged.
REQUIRED = ["normalized_key", "object_path", "schema_name", "kind", "object_name", "planned_action", "exists"]
COUNTS = ["objectCount", "createCount", "adoptCount", "skipCount", "changedCount", "blockedCount"]


def _from_wire(objects: DataFrame, prefix: str = "") -> DataFrame:
    raw = F.try_to_binary(F.col(f"{prefix}checksum"), F.lit("base64"))
    good = F.coalesce(F.octet_length(raw) == 32, F.lit(False))
    digest = F.when(good, F.lower(F.hex(raw))).otherwise(
        F.raise_error(F.lit("checksum must be 32 bytes")).cast("string")
    )
    cols = []
    for name, wire in WIRE.items():
        c = digest if name == "checksum" else F.col(f"{prefix}{wire}")
        if name in _OMIT_BLANK:
            c = F.coalesce(c, F.lit(""))
        if name in REQUIRED:
            kind = "boolean" if name == "exists" else "string"
            missing = F.raise_error(F.lit(f"plan object without {wire}")).cast(kind)
            c = F.when(c.isNull(), missing).otherwise(c)
        if name == "planned_action":
            known = c.isin(sorted(set(ACTIONS.values())))
            c = F.when(known, c).otherwise(
                F.raise_error(F.concat(F.lit("unknown action "), c)).cast("string")
            )
        cols.append(c.alias(name))
    keep = [c for c in ("command", "planned_at") if c in objects.columns]
    return objects.select(*keep, *cols)


def read_plans(
    spark: SparkSession, path: str, layout: str = "document", multi_line: bool = True
) -> DataFrame:
    """Plan objects as rows.

    ``document``: one JSON document per file (``multi_line``) or line, from any tool;
    ``parts``: what :func:`write_plan_documents` wrote; ``lines``: one object per line.
    An object that lacks a required field, names no known action or has a checksum that
    isn't 32 bytes fails the job, as do parts that don't add up to their count.
    """
    if layout == "lines":
        lines = spark.read.schema(PLAN_OBJECT).option("mode", "FAILFAST").json(f"{path}/objects")
        return _from_wire(lines)
    if layout == "parts":
        return _read_parts(spark, path)
    docs = spark.read.schema(PLAN_DOC).option("mode", "FAILFAST").json(path, multiLine=multi_line)
    rows = docs.select(
        "command", F.col("plannedAt").alias("planned_at"), F.explode("objects").alias("o")
    )
    return _from_wire(rows, "o.")


def _read_parts(spark: SparkSession, path: str) -> DataFrame:
    lines = dc.read_lines(spark, path)
    # Every line says by its beginning what it is; a blocker begins with a quote.
    is_object = F.col("line").startswith('{"normalizedKey"')
    closing = F.when(F.col("line").startswith('],"summary"'), F.concat(F.lit("{"), F.substr("line", F.lit(3))))
    expected = F.get_json_object(closing, "$.summary.objectCount").cast("long")
    found = lines.groupBy("doc").agg(F.count_if(is_object).alias("n"), F.max(expected).alias("expected"))
    if not found.filter("expected is null or n <> expected").isEmpty():
        raise ValueError("a plan document is incomplete")
    opening = F.when(F.col("line").startswith('{"command"'), F.concat("line", F.lit("]}")))
    heads = lines.filter(F.col("line").startswith('{"command"')).select(
        "doc", F.get_json_object(opening, "$.command").alias("command"),
        F.get_json_object(opening, "$.plannedAt").alias("planned_at"),
    )
    rows = lines.filter(is_object).join(heads, "doc").select(
        "command", "planned_at", F.from_json("line", PLAN_OBJECT, {"mode": "FAILFAST"}).alias("o")
    )
    return _from_wire(rows, "o.")


def _to_wire(plan: DataFrame) -> list:
    out = []
    for name, wire in WIRE.items():
        if name not in plan.columns:
            continue
        c = F.col(name)
        if name == "checksum":
            c = F.base64(F.unhex("checksum"))
        elif name in _OMIT_BLANK:
            c = F.nullif(c, F.lit(""))
        elif name == "transition_paths":
            c = F.when(F.size(c) > 0, c)
        out.append(c.alias(wire))
    return out


def _kept(plan: DataFrame) -> DataFrame:
    """The plan's JSON objects and what its heads count, evaluated once and written."""
    path = work_path(plan.sparkSession, "plan-wire")
    flag = F.col("counter")
    plan.select(
        F.coalesce("database_name", F.lit("")).alias("doc"), F.col("normalized_key").alias("key"),
        F.struct(*_to_wire(plan)).alias("wire"),
        "blocked", "message",
        *[(flag == c).alias(c) for c in ("create", "adopt", "skip", "changed")],
    ).write.parquet(path)
    return plan.sparkSession.read.parquet(path)


def _counts() -> list:
    return [
        F.count(F.lit(1)).alias("objectCount"),
        *[F.count_if(c).alias(f"{c}Count") for c in ("create", "adopt", "skip", "changed", "blocked")],
    ]


def write_plans(
    plan: DataFrame, path: str, command: str = "plan", planned_at: str = "",
    schemas: DataFrame | None = None,
) -> None:
    """One JSON object per line in ``objects``; NULL and blank fields are left out.

    ``header`` holds command, time, verdict and counts, ``blockers`` the blocking rows,
    ``schemas`` the schemas and what is done to them.  There is no size limit, and
    no order across files.
    """
    rows = _kept(plan)
    rows.select("wire.*").write.mode("overwrite").option("ignoreNullFields", True).json(f"{path}/objects")
    rows.filter("blocked").select(
        F.col("doc").alias("databaseName"), F.col("key").alias("normalizedKey"), "message"
    ).write.mode("overwrite").json(f"{path}/blockers")
    if schemas is None:
        named = rows.sparkSession.createDataFrame([], "databaseName string, schemaName string, action string")
    else:
        named = schemas.select(F.col("database_name").alias("databaseName"), F.col("schema_name").alias("schemaName"), "action")
    named.write.mode("overwrite").json(f"{path}/schemas")
    many = rows.sparkSession.read.schema("action string").json(f"{path}/schemas")
    rows.agg(*_counts()).crossJoin(many.agg(F.count(F.lit(1)).alias("schemaCount"))).select(
        F.lit(command).alias("command"),
        F.lit(planned_at).alias("plannedAt"),
        (F.col("blockedCount") > 0).alias("blocked"),
        "objectCount", "blockedCount",
        F.struct("schemaCount", *COUNTS).alias("summary"),
    ).write.mode("overwrite").json(f"{path}/header")


def write_plan_documents(
    plan: DataFrame, schemas: DataFrame, path: str, command: str = "plan", planned_at: str = ""
) -> None:
    """One nested document per database, of any size, for tools that read whole documents.

    The document of a database is the concatenation of the files in ``doc=<database>``
    in name order; see :mod:`reconcile.sources.documents`.
    """
    rows = _kept(plan).withColumn("text", F.to_json("wire", {"ignoreNullFields": "true"}))
    spark = rows.sparkSession
    named_path = work_path(spark, "plan-schemas")
    pair = F.struct("action", F.col("schema_name").alias("schemaName"))
    schemas.select(
        F.coalesce("database_name", F.lit("")).alias("doc"), F.col("schema_name").alias("key"), F.to_json(pair).alias("text")
    ).distinct().write.parquet(named_path)
    named = spark.read.parquet(named_path)

    # One row per database.
    heads = rows.groupBy("doc").agg(
        *_counts(), F.min("key").alias("first_object"), F.min(F.when(F.col("blocked"), F.col("key"))).alias("first_blocker")
    ).join(
        named.groupBy("doc").agg(F.count(F.lit(1)).alias("schemaCount"), F.min("key").alias("first_schema")), "doc", "left"
    ).withColumn("schemaCount", F.coalesce("schemaCount", F.lit(0)))
    blocked = F.col("blockedCount") > 0
    front = F.to_json(F.struct(F.lit(command).alias("command"), F.lit(planned_at).alias("plannedAt"), blocked.alias("blocked")))
    front = F.regexp_replace(front, r"\}\z", ",")
    summary = F.to_json(F.struct("schemaCount", *COUNTS))
    first = lambda c: heads.select("doc", F.col(c).alias("first"))
    blockers = rows.filter("blocked").select(
        "doc", "key", F.regexp_extract(F.to_json(F.struct("message")), r'^\{"message":(.*)\}\z', 1).alias("text")
    )
    parts = [
        dc.lines_of(heads, 0, F.concat(front, F.when(blocked, '"blockers":[').otherwise('"schemas":['))),
        dc.item_lines(blockers, 1, first("first_blocker")),
        dc.lines_of(heads, 2, F.when(blocked, '],"schemas":[')),
        dc.item_lines(named, 3, first("first_schema")),
        dc.lines_of(heads, 4, F.lit('],"objects":[')),
        dc.item_lines(rows, 5, first("first_object")),
        dc.lines_of(heads, 6, F.concat(F.lit('],"summary":'), summary, F.lit("}"))),
    ]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    dc.write_documents(lines, path)
