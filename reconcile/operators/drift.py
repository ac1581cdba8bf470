"""Suspects, live fingerprints and the drift decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reconcile import KEY
from reconcile.functions import paths, scenarios as sc


def suspects(latest: DataFrame, object_ddl: DataFrame, force_full: bool = False) -> DataFrame:
    """``latest`` with ``suspect``: the live state may have moved since the
    recorded version.  Without a trusted change signal everything is suspect."""
    if force_full:
        return latest.withColumn("suspect", F.lit(True))
    versions = object_ddl.select(*KEY, "ddl_version")
    flag = F.col("applied_ddl_version").isNull() | (
        F.coalesce("ddl_version", F.lit(0)) > F.col("applied_ddl_version")
    )
    return latest.join(versions, KEY, "left").withColumn("suspect", flag).drop("ddl_version")


def drift(flagged: DataFrame, live: DataFrame) -> DataFrame:
    """``flagged`` (from :func:`suspects`) with the boolean ``drift``.

    ``live`` holds ``live_checksum`` per key and needs rows for suspects only.
    """
    kind = paths.split_key(F.col("normalized_key"))["kind"]
    flag = sc.drift_flag(
        kind,
        F.col("checksum"),
        F.col("live_definition_checksum"),
        F.col("suspect"),
        F.col("live_checksum"),
    )
    return (
        flagged.join(live.select(*KEY, "live_checksum"), KEY, "left")
        .withColumn("drift", flag)
        .drop("live_checksum")
    )


def suspect_keys(flagged: DataFrame) -> DataFrame:
    """Keys whose live state must be fingerprinted; join with ``left_semi``
    before building the canonical state, not with a guard inside it."""
    return flagged.filter("suspect").select(*KEY)
