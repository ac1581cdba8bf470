"""Audit log tail to the latest row per key.

The running state can be had in two ways: from the batches a sink wrote, or straight
from the stream's state store.  The store holds one row per key however many
batches there were, and its change feed gives the keys that moved between two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconcile import KEY
from reconcile.operators.history import LIVE_EVENTS

VALUES = ["checksum", "live_definition_checksum", "applied_ddl_version"]

# Changes of each batch are uploaded as a log, which is what the change feed reads.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _live(history: DataFrame) -> DataFrame:
    return history.filter((F.col("kind") == "object") & F.col("event").isin(LIVE_EVENTS))


def stream_latest_history(history: DataFrame) -> DataFrame:
    """Running latest object row per key; for ``update`` or ``complete`` mode."""
    return _live(history).groupBy(*KEY).agg(
        F.max("id").alias("id"), F.max_by(F.struct(*VALUES), "id").alias("last")
    ).select(*KEY, "id", "last.*")


def read_latest_history(spark: SparkSession, state: str) -> DataFrame:
    """Fold the batches a sink wrote."""
    return spark.read.parquet(state).groupBy(*KEY).agg(
        F.max("id").alias("id"), F.max_by(F.struct(*VALUES), "id").alias("last")
    ).select(*KEY, "id", "last.*")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep_latest_history(history: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Start the stream that keeps the latest row per key in the state below ``checkpoint``.

    A checkpoint stays with the number of partitions it was begun with.  Restarted
    on the same checkpoint the stream goes on after the rows it has seen.
    """
    # One aggregate, so that the state holds one struct per key; ids are unique.
    last = _live(history).groupBy(*KEY).agg(F.max(F.struct("id", *VALUES)).alias("last"))
    with _settings(history.sparkSession, STATE):
        return (
            last.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def latest_from_state(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """Latest row per key out of the state store, at the end or as of a batch.

    Fit for ``compute_plan(..., latest=)``; what is read grows with the keys.
    """
    with _settings(spark, STATE):
        reader = spark.read.format("statestore")
        if batch is not None:
            reader = reader.option("batchId", batch)
        state = reader.load(checkpoint)
        only = state.schema["value"].dataType.names[0]
        return state.select(
            *[F.col(f"key.{k}").alias(k) for k in KEY],
            *[F.col("value")[only][c].alias(c) for c in ("id", *VALUES)],
        )


def changed_in_state(spark: SparkSession, checkpoint: str, first: int, last: int) -> DataFrame:
    """Latest row, as of batch ``last``, of every key written in batches ``first`` to ``last``."""
    with _settings(spark, STATE):
        feed = (
            spark.read.format("statestore").option("readChangeFeed", True)
            .option("changeStartBatchId", first).option("changeEndBatchId", last).load(checkpoint)
        )
        only = feed.schema["value"].dataType.names[0]
        # The state of a key only moves to higher ids.
        moved = feed.filter("change_type = 'update'").groupBy(
            *[F.col(f"key.{k}").alias(k) for k in KEY]
        ).agg(F.max(F.col("value")[only]).alias("last"))
        return moved.select(*KEY, *[F.col("last")[c].alias(c) for c in ("id", *VALUES)])
