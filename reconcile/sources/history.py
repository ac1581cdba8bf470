"""The append-only audit log on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconcile.operators.history import guarded
from reconcile.schemas import HISTORY, conform


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Log rows; columns that older files lack read as NULL."""
    return spark.read.schema(HISTORY).parquet(path)


def append_history(records: DataFrame, path: str, after_id: int = 0) -> None:
    """Append ``records`` with ids above ``after_id``, one folder per row kind
    so that object and change-script lookups each read only their part.

    The fingerprint guard runs in the same job, so a violation writes nothing.
    Records that bring an ``id`` keep it; others are numbered per partition,
    unique and above ``after_id`` but not dense.
    """
    rows = guarded(records)
    if "id" not in rows.columns:
        rows = rows.withColumn(
            "id", F.monotonically_increasing_id() + F.lit(after_id + 1)
        )
    conform(rows, HISTORY).write.mode("append").partitionBy("kind").parquet(path)


def last_id(history: DataFrame) -> int:
    return history.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
