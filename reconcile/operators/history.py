"""The audit log: latest rows per key, guards, appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reconcile import KEY
from reconcile.functions import checksums as ck, kinds, paths
from reconcile.functions.text import strip

LIVE_EVENTS = ["applied", "adopted"]


def _latest(rows: DataFrame, values: list[str]) -> DataFrame:
    # max_by combines map-side, so each map task ships one row per key however
    # often a hot key occurs.
    return rows.groupBy(*KEY).agg(
        F.max("id").alias("id"),
        F.max_by(F.struct(*values), F.col("id")).alias("last"),
    )


def latest_object_history(history: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Newest applied or adopted object row per key.

    ``keys`` restricts the result; the semi join runs on the aggregated rows,
    which already sit in the partitioning it needs.
    """
    rows = history.filter(
        (F.col("kind") == "object") & F.col("event").isin(LIVE_EVENTS)
    )
    out = _latest(rows, ["checksum", "live_definition_checksum", "applied_ddl_version"])
    out = out.select(*KEY, "id", "last.*")
    if keys is not None:
        out = out.join(keys.select(*KEY), KEY, "left_semi")
    return out


def latest_migrations(history: DataFrame) -> DataFrame:
    """Newest applied change script per path."""
    rows = history.filter((F.col("kind") == "migration") & (F.col("event") == "applied"))
    return _latest(rows, ["checksum"]).select(
        *KEY, "id", strip(F.coalesce("last.checksum", F.lit(""))).alias("checksum")
    ).filter(F.col("normalized_key") != "")


def object_ddl(events: DataFrame) -> DataFrame:
    """Newest change version per object."""
    return events.groupBy(*KEY).agg(
        F.max("ddl_version").alias("ddl_version"), F.max("updated_at").alias("updated_at")
    )


def missing_fingerprints(records: DataFrame) -> DataFrame:
    """Records that claim a live object but carry no fingerprint of it."""
    kind = paths.split_key(F.col("normalized_key"))["kind"]
    return records.filter(
        (F.col("kind") == "object")
        & F.col("event").isin(LIVE_EVENTS)
        & kinds.is_managed(kind)
        & F.col("live_definition_checksum").isNull()
    )


def invalid_checksums(latest: DataFrame) -> DataFrame:
    """Latest rows whose stored checksum cannot be decoded."""
    return latest.filter(~ck.decode_checksum(F.col("checksum"))["valid"]).select(
        *KEY,
        "checksum",
        F.format_string(
            "audit history checksum for %s is undecodable", F.col("normalized_key")
        ).alias("message"),
    )


def decoded(checksum: Column, repair: bool = False) -> Column:
    """Decoded checksum of the row's key.  An undecodable value fails the job,
    or becomes the zero digest when ``repair`` is set."""
    bad = F.lit(ck.ZERO_DIGEST) if repair else F.raise_error(
        F.format_string(
            "audit history checksum for %s is undecodable", F.col("normalized_key")
        )
    ).cast("string")
    return F.coalesce(ck.decode_checksum(checksum)["value"], bad)


def decoded_checksums(latest: DataFrame, repair: bool = False) -> DataFrame:
    return latest.withColumn("checksum", decoded(F.col("checksum"), repair))


def append_history(history: DataFrame, records: DataFrame) -> DataFrame:
    """Log with ``records`` appended in memory; the guard fails the job when a
    managed object row has no fingerprint.  Use ``sources.history`` to persist."""
    return history.unionByName(guarded(records), allowMissingColumns=True)


def guarded(records: DataFrame) -> DataFrame:
    """Pass records through unless C6 is violated, in the same job."""
    kind = paths.split_key(F.col("normalized_key"))["kind"]
    bad = (
        (F.col("kind") == "object")
        & F.col("event").isin(LIVE_EVENTS)
        & kinds.is_managed(kind)
        & F.col("live_definition_checksum").isNull()
    )
    msg = F.format_string(
        "cannot capture live state checksum of %s", F.col("normalized_key")
    )
    # The check yields the key itself so that pruning cannot drop it.
    return records.withColumn(
        "normalized_key",
        F.when(bad, F.raise_error(msg).cast("string")).otherwise(F.col("normalized_key")),
    )


def is_empty(df: DataFrame) -> bool:
    """Stops at the first row found."""
    return df.isEmpty()


def empty_databases(databases: DataFrame, rows: DataFrame) -> DataFrame:
    """Per database whether ``rows`` holds none of it."""
    seen = rows.select("database_name").distinct().withColumn("_seen", F.lit(True))
    return databases.select("database_name").distinct().join(seen, "database_name", "left").select(
        "database_name", F.col("_seen").isNull().alias("empty")
    )


def emptiness(df: DataFrame) -> DataFrame:
    """The same probe as a one-row frame."""
    return df.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))
