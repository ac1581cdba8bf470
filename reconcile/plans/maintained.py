"""A plan kept up to date by the change stream.

The plan lies in buckets of its key.  A change recomputes the rows of the changed keys
and of those that depend on them and rewrites only the buckets these rows are in; a
version file says for every bucket which version of it is in force, so readers
always see one whole plan, and a batch that is replayed after a stop changes
nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconcile import KEY
from reconcile.functions import paths
from reconcile.operators import scope as scp
from reconcile.plans.reconciliation import PLAN_COLUMNS, compute_plan
from reconcile.sources.versions import VersionLog, subfolders
from reconcile.streaming import changes as ch

BUCKETS = 64


@dataclass(frozen=True)
class Inputs:
    """What a plan is computed from, apart from the change signal."""

    manifest: DataFrame
    catalog: DataFrame
    latest: DataFrame
    transitions: DataFrame
    live: Callable[[DataFrame], DataFrame]


def affected_keys(changed: DataFrame, manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Changed keys, the parents of triggers among them, and the triggers of tables among them."""
    own = changed.select(*KEY).distinct()
    schema = paths.split_key(F.col("normalized_key"))["schema_name"]
    children = (
        catalog.filter((F.col("kind") == "triggers") & (F.coalesce("parent_name", F.lit("")) != ""))
        .select(*KEY, paths.normalized_key(schema, F.lit("tables"), F.col("parent_name")).alias("_parent"))
        .join(own.withColumnRenamed("normalized_key", "_parent"), ["database_name", "_parent"], "left_semi")
        .select(*KEY)
    )
    return scp.expand_delta(own, manifest, catalog).select(*KEY).unionByName(children).distinct()


def recompute(keys: DataFrame, inputs: Inputs, object_ddl: DataFrame) -> DataFrame:
    """Plan rows of ``keys`` alone; inputs are cut to them and the parents they look up."""
    needed = scp.expand_delta(keys, inputs.manifest, inputs.catalog).select(*KEY)
    part = lambda df: df.join(needed, KEY, "left_semi")
    plan = compute_plan(
        part(inputs.manifest), part(inputs.catalog), None, part(object_ddl), part(inputs.transitions),
        inputs.live, latest=part(inputs.latest),
    )
    return plan.join(keys.select(*KEY), KEY, "left_semi")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket")


def _write(rows: DataFrame, path: str, buckets: int, folder: str) -> list[int]:
    """Rows in one folder per bucket; the buckets that hold any."""
    # Buckets are cut by a hash of the key, which is unique, so they are even.
    rows.select("*", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy(
        "bucket"
    ).parquet(f"{path}/{folder}")
    names = subfolders(rows.sparkSession, f"{path}/{folder}")
    return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]


def create_plan(plan: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Version 0: the whole plan."""
    log = VersionLog(plan.sparkSession, path)
    held = _write(plan.select(*PLAN_COLUMNS), path, buckets, "plan-0")
    content = {"buckets": buckets, "folders": {str(b): "plan-0" for b in held}, "batch": -1}
    if not log.take(0, content):
        raise ValueError("there is a plan already")


def _schema() -> str:
    kinds = {c: "string" for c in PLAN_COLUMNS} | {"exists": "boolean", "drift": "boolean", "transitions": "long", "blocked": "boolean", "needs_provenance": "boolean"}
    return ", ".join(f"`{c}` {kinds[c]}" for c in PLAN_COLUMNS)


def _read(spark: SparkSession, path: str, content: dict, only: list[int] | None = None) -> DataFrame:
    folders = [
        f"{path}/{f}/bucket={b}" for b, f in content["folders"].items() if only is None or int(b) in only
    ]
    reader = spark.read.schema(_schema())
    return reader.parquet(*folders) if folders else spark.createDataFrame([], _schema())


def read_plan(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The plan in force, or as it was at an earlier version."""
    log = VersionLog(spark, path)
    last = log.latest() if version is None else version
    if last is None:
        raise ValueError("there is no plan yet")
    return _read(spark, path, log.read(last))


def merge_plan(spark: SparkSession, path: str, keys: DataFrame, rows: DataFrame, batch: int) -> bool:
    """Replace the rows of ``keys`` by ``rows``; a key without a row goes.

    A batch already in the plan changes nothing, and gives False.
    """
    log = VersionLog(spark, path)
    last = log.latest()
    before = log.read(last)
    if batch <= before["batch"]:
        return False
    buckets = before["buckets"]
    # At most as many numbers as there are buckets.
    touched = [r.bucket for r in keys.select(_bucket(buckets)).distinct().collect()]
    stay = _read(spark, path, before, touched).join(keys.select(*KEY), KEY, "left_anti")
    folder = f"plan-{last + 1}-{batch}"
    held = _write(stay.unionByName(rows.select(*PLAN_COLUMNS)), path, buckets, folder)
    folders = {b: f for b, f in before["folders"].items() if int(b) not in touched}
    folders |= {str(b): folder for b in held}
    if not log.take(last + 1, {"buckets": buckets, "folders": folders, "batch": batch}):
        raise RuntimeError("another writer changed the plan meanwhile")
    return True


def apply_changes(
    spark: SparkSession, path: str, batch_id: int, updates: DataFrame, inputs: Inputs
) -> None:
    """Bring the plan up to one batch of versions by object name.

    Below ``path`` the batch's versions (``versions_seen``) and the keys it reached
    (``affected``) are kept in folders of the batch, which a replay overwrites.
    """
    seen = f"{path}/versions_seen"
    updates.write.mode("overwrite").parquet(f"{seen}/batch_id={batch_id}")
    mine = spark.read.parquet(f"{seen}/batch_id={batch_id}")
    changed = ch.keyed_versions(mine, inputs.manifest)
    reached = f"{path}/affected/batch_id={batch_id}"
    affected_keys(changed, inputs.manifest, inputs.catalog).write.mode("overwrite").parquet(reached)
    keys = spark.read.parquet(reached)
    if keys.isEmpty():
        return
    versions = ch.keyed_versions(ch.read_object_ddl(spark, seen), inputs.manifest)
    merge_plan(spark, path, keys, recompute(keys, inputs, versions), batch_id)


def maintain(
    events: DataFrame, path: str, checkpoint: str, inputs: Inputs, metadata_schema: str = "deploy_meta",
    trigger: dict | None = None,
):
    """Start the stream of change events that keeps the plan at ``path`` up to date."""
    spark = events.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        apply_changes(spark, path, batch_id, batch, inputs)

    return (
        ch.stream_object_ddl(events, metadata_schema).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(each)
        .start()
    )
