"""Change events to the latest version per object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconcile import KEY

# Operations and object classes that move an object's version.
WATCHED = {
    "table": "tables", "index": "indexes", "view": "views", "procedure": "procedures",
    "function": "functions", "trigger": "triggers", "synonym": "synonyms",
    "sequence": "sequences", "type": "types",
}
NO_ALTER = ["synonym", "type"]


def watched_event(event_type):
    """CREATE, ALTER or DROP of a watched class."""
    parts = F.split(F.lower(event_type), "_", 2)
    verb, what = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    known = what.isin(list(WATCHED)) & verb.isin("create", "alter", "drop")
    return F.coalesce(known & ~((verb == "alter") & what.isin(NO_ALTER)), F.lit(False))


def change_rows(events: DataFrame, metadata_schema: str = "deploy_meta") -> DataFrame:
    """Versions of the objects that events name, on names folded to lower case.

    ``events``: database_name, event_type, schema_name, object_name, version, ts.
    The tool's own metadata schema and events without names are ignored.
    """
    named = F.col("schema_name").isNotNull() & F.col("object_name").isNotNull()
    foreign = F.lower("schema_name") != metadata_schema
    return events.filter(watched_event(F.col("event_type")) & named & foreign).select(
        "database_name",
        F.lower("schema_name").alias("schema_name"),
        F.lower("object_name").alias("object_name"),
        F.col("version").alias("ddl_version"),
        F.col("ts").alias("updated_at"),
    )


NAME = ["database_name", "schema_name", "object_name"]


def stream_object_ddl(events: DataFrame, metadata_schema: str = "deploy_meta") -> DataFrame:
    """Running latest version per object; for ``update`` or ``complete`` mode."""
    return change_rows(events, metadata_schema).groupBy(*NAME).agg(
        F.max("ddl_version").alias("ddl_version"), F.max("updated_at").alias("updated_at")
    )


def keyed_versions(object_ddl: DataFrame, manifest: DataFrame) -> DataFrame:
    """Versions by object name joined onto manifest keys."""
    on = NAME
    return manifest.select(*KEY, *on[1:]).join(object_ddl, on, "inner").select(
        *KEY, "ddl_version", "updated_at"
    )


def upsert_query(updates: DataFrame, state: str, checkpoint: str, trigger: dict | None = None):
    """Start the sink: every micro-batch writes its changed rows to its own
    folder, so a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    return (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def _fold(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*NAME).agg(
        F.max("ddl_version").alias("ddl_version"), F.max("updated_at").alias("updated_at")
    )


def read_object_ddl(
    spark: SparkSession, state: str, base: str | None = None, after: int = -1
) -> DataFrame:
    """Fold the batches: the highest version of an object is its state.

    With a compacted ``base`` only batches past ``after`` are read from ``state``.
    """
    rows = spark.read.parquet(state).filter(F.col("batch_id") > after).drop("batch_id")
    return _fold(rows if base is None else rows.unionByName(spark.read.parquet(base)))


def compact_object_ddl(
    spark: SparkSession, state: str, target: str, base: str | None = None, after: int = -1
) -> int:
    """Write the folded state to ``target`` and return the last batch in it,
    the ``after`` of later reads.  Batches that arrive meanwhile stay out."""
    ids = spark.read.parquet(state).agg(F.max("batch_id")).first()
    last = after if ids[0] is None else max(after, ids[0])
    rows = spark.read.parquet(state).filter(F.col("batch_id").between(after + 1, last))
    rows = rows.drop("batch_id")
    if base is not None:
        rows = rows.unionByName(spark.read.parquet(base))
    _fold(rows).write.mode("errorifexists").parquet(target)
    return last


def stream_suspects(events: DataFrame, latest: DataFrame) -> DataFrame:
    """Change events joined with the recorded version of their object: rows
    whose live state may have moved.  ``events``: keys and ``ddl_version``."""
    recorded = latest.select(*KEY, "applied_ddl_version")
    moved = F.col("applied_ddl_version").isNull() | (
        F.col("ddl_version") > F.col("applied_ddl_version")
    )
    return events.join(recorded, KEY, "inner").filter(moved)


def stream_uncleared(
    events: DataFrame, audits: DataFrame, horizon: str = "1 day", lateness: str = "1 hour"
) -> DataFrame:
    """Change events that no audit row has caught up with, against a log that moves too.

    ``events``: keys, ``ddl_version``, ``ts``; ``audits``: keys, ``applied_ddl_version``,
    ``created_at``, both streams.  An audit row of the same key with at least the
    event's version, written at most ``horizon`` before or after it, clears the event,
    whichever arrives first.  An event is given out once the watermark shows that none
    can come any more.  Rows more than ``lateness`` behind are dropped, as the
    watermark says: a late event isn't reported, a late audit row clears nothing.

    Both sides are kept in the state for ``horizon`` plus ``lateness`` only, spread by key.
    """
    left = events.select(*KEY, "ddl_version", "ts").withWatermark("ts", lateness)
    right = audits.select(
        *[F.col(k).alias(f"_{k}") for k in KEY], "applied_ddl_version", "created_at"
    ).withWatermark("created_at", lateness)
    span = F.expr(f"interval {horizon}")
    same = [F.col(k) == F.col(f"_{k}") for k in KEY]
    on = (
        same[0] & same[1] & (F.col("applied_ddl_version") >= F.col("ddl_version"))
        & (F.col("created_at") >= F.col("ts") - span) & (F.col("created_at") <= F.col("ts") + span)
    )
    # An event may meet several audit rows; those pairs end here.
    return left.join(right, on, "left_outer").filter(F.col("_normalized_key").isNull()).select(
        *KEY, "ddl_version", "ts"
    )
