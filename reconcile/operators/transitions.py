"""Authored change scripts of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reconcile import KEY


def link_transitions(transitions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Change scripts of managed tables, within their own database."""
    tables = manifest.filter(F.col("kind") == "tables").select(*KEY, "object_path")
    return transitions.join(tables, KEY, "inner")


def transition_counts(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy(*KEY).agg(F.count(F.lit(1)).alias("transitions"))


def transition_lists(transitions: DataFrame) -> DataFrame:
    """Paths per table in ordinal order.

    An ordinal has three digits and may occur once per table, so a list holds
    at most 1000 entries; a repeated ordinal fails the job instead of growing it.
    """
    once = transitions.groupBy(*KEY, "ordinal").agg(
        F.min("path").alias("path"), F.count(F.lit(1)).alias("n")
    )
    msg = F.format_string(
        "duplicate transition ordinal %s for %s",
        F.col("ordinal").cast("string"), F.col("normalized_key"),
    )
    path = F.when(F.col("n") > 1, F.raise_error(msg).cast("string")).otherwise(F.col("path"))
    item = F.struct("ordinal", path.alias("path"))
    return once.groupBy(*KEY).agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda t: t["path"]).alias("paths")
    )


def with_transition_paths(plan: DataFrame, lists: DataFrame) -> DataFrame:
    """Attach the path list to rows that will replay change scripts."""
    on_plan = F.col("planned_action") == "reprocess_changed"
    return plan.join(lists, KEY, "left").withColumn(
        "transition_paths", F.when(on_plan, F.col("paths"))
    ).drop("paths")


def _against_log(plan: DataFrame, transitions: DataFrame, migrations: DataFrame) -> DataFrame:
    due = plan.filter(F.col("planned_action") == "reprocess_changed").select(*KEY)
    log = migrations.select(
        "database_name",
        F.col("normalized_key").alias("path"),
        F.col("checksum").alias("recorded"),
    )
    return transitions.join(due, KEY, "left_semi").join(log, ["database_name", "path"], "left")


def pending_transitions(
    plan: DataFrame, transitions: DataFrame, migrations: DataFrame
) -> DataFrame:
    """Change scripts still to run for tables that replay them."""
    return _against_log(plan, transitions, migrations).filter(
        F.col("recorded").isNull()
    ).drop("recorded")


def tampered_transitions(
    plan: DataFrame, transitions: DataFrame, migrations: DataFrame
) -> DataFrame:
    """Applied scripts whose bytes changed since; a blank record is trusted."""
    return _against_log(plan, transitions, migrations).filter(
        (F.col("recorded") != "") & (F.col("recorded") != F.col("checksum"))
    )


def creation_records(plan: DataFrame, transitions: DataFrame) -> DataFrame:
    """Audit rows of created objects.  A new table already embodies all its
    change scripts, so those are recorded as applied along with it."""
    # A table has at most as many scripts as there are ordinals, so they travel to its
    # row as one list and the plan is evaluated once.
    step = F.struct(
        F.col("path").alias("normalized_key"), F.lit("migration").alias("kind"), "checksum"
    )
    steps = transitions.groupBy(*KEY).agg(F.collect_list(step).alias("_steps"))
    made = plan.filter(F.col("planned_action") == "create_object").select(*KEY, "kind", "checksum")
    own = F.struct("normalized_key", F.lit("object").alias("kind"), "checksum")
    filled = F.transform(
        F.when(F.col("kind") == "tables", F.col("_steps")),
        lambda s: s.withField("checksum", F.coalesce(s["checksum"], F.col("checksum"))),
    )
    rows = F.concat(F.array(own), F.coalesce(filled, F.array().cast("array<struct<normalized_key:string,kind:string,checksum:string>>")))
    return made.join(steps, KEY, "left").select("database_name", F.explode(rows).alias("r")).select(
        "database_name", "r.*", F.lit("applied").alias("event")
    )
