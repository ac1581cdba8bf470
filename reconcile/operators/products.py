"""What is read off a finished plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reconcile import KEY
from reconcile.functions import kinds

COUNT_COLUMNS = [
    "schema_count", "object_count", "create_count", "adopt_count", "skip_count",
    "changed_count", "blocked_count",
]


def plan_summary(plan: DataFrame, schemas: DataFrame, total: bool = False) -> DataFrame:
    """Counts per database; ``total`` adds one row with a NULL database.

    A blocked row is also counted as changed.
    """
    counts = [
        F.count(F.lit(1)).alias("object_count"),
        F.count_if(F.col("counter") == "create").alias("create_count"),
        F.count_if(F.col("counter") == "adopt").alias("adopt_count"),
        F.count_if(F.col("counter") == "skip").alias("skip_count"),
        F.count_if(F.col("counter") == "changed").alias("changed_count"),
        F.count_if(F.col("blocked")).alias("blocked_count"),
    ]
    by_schema = F.count(F.lit(1)).alias("schema_count")
    if total:
        objects = plan.rollup("database_name").agg(*counts)
        layout = schemas.rollup("database_name").agg(by_schema)
    else:
        objects = plan.groupBy("database_name").agg(*counts)
        layout = schemas.groupBy("database_name").agg(by_schema)
    joined = objects.join(
        layout.withColumnRenamed("database_name", "_d"),
        F.col("database_name").eqNullSafe(F.col("_d")),
        "left",
    )
    return joined.withColumn(
        "schema_count", F.coalesce("schema_count", F.lit(0))
    ).select("database_name", *COUNT_COLUMNS)


def action_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("planned_action").agg(F.count(F.lit(1)).alias("n"))


def plan_blockers(plan: DataFrame) -> DataFrame:
    """Blocking rows with their message, ordered by database and key.  Rows, not
    one list: a plan may be blocked in any number of places."""
    return plan.filter("blocked").select(*KEY, "scenario", "message").orderBy(*KEY)


def plan_verdict(plan: DataFrame) -> DataFrame:
    """Per database whether the plan may be executed."""
    return plan.groupBy("database_name").agg(
        F.bool_or("blocked").alias("blocked"),
        F.count_if(F.col("blocked")).alias("blockers"),
    )


def order_plan(plan: DataFrame) -> DataFrame:
    return plan.orderBy(*KEY)


def deploy_order(plan: DataFrame) -> DataFrame:
    """Rows to execute: transactional kinds by rank, then modules."""
    todo = plan.filter(F.col("planned_action").isin("create_object", "update_existing_module"))
    return (
        todo.withColumn("batch", F.when(kinds.is_transactional(F.col("kind")), 0).otherwise(1))
        .withColumn("rank", kinds.kind_rank(F.col("kind")))
        .orderBy("batch", "rank", "normalized_key", "database_name")
    )


def adoption_gate(plan: DataFrame, allow: bool = False) -> DataFrame:
    """Rows that would be adopted unseen; empty when adoption is allowed."""
    adopts = plan.filter(F.col("planned_action") == "adopt_existing").select(*KEY)
    return adopts.filter(F.lit(False)) if allow else adopts


def adoption_sample(gate: DataFrame, k: int = 10) -> DataFrame:
    """The first few blocked adoptions, for a log line."""
    return gate.orderBy(*KEY).limit(k)


REPAIRED = [
    "update_existing_module", "reprocess_changed", "reprocess_changed_blocked", "fail",
]


def metadata_records(plan: DataFrame, mode: str = "baseline") -> DataFrame:
    """Audit rows of a metadata-only run.

    ``baseline`` adopts and refuses a blocked plan; ``repair`` also records the
    current checksum of changed, blocked and failed rows.
    """
    if mode not in ("baseline", "repair"):
        raise ValueError(f"unknown metadata mode: {mode}")
    adopt = F.col("planned_action") == "adopt_existing"
    # A blocked row refuses the run where the rows are chosen, so in the same pass
    # and whatever columns are read.
    refuse = F.raise_error(F.lit("plan is blocked: baseline refused")).cast("boolean")
    keep = (
        F.when(F.col("blocked"), refuse).otherwise(adopt) if mode == "baseline"
        else adopt | F.col("planned_action").isin(REPAIRED)
    )
    return plan.filter(keep).select(
        *KEY,
        F.lit("object").alias("kind"),
        "checksum",
        F.when(adopt, "adopted").otherwise("applied").alias("event"),
    )


def with_provenance(plan: DataFrame, commits: DataFrame) -> DataFrame:
    """Commit hash, author and date on every row that is not skipped."""
    need = F.col("needs_provenance")
    fields = ["git_hash", "git_author", "git_date"]
    latest = commits.select("object_path", *fields)
    out = plan.join(latest, "object_path", "left")
    return out.select(*plan.columns, *[F.when(need, F.col(c)).alias(c) for c in fields])


def apply_outcome(
    plan: DataFrame,
    schemas: DataFrame,
    pending: DataFrame,
    failures: DataFrame | None = None,
) -> DataFrame:
    """applied / skipped / failed per database for an executed plan.

    ``failures`` lists keys that raised an error; everything else due counts
    as applied: created schemas, pending change scripts, objects.
    """
    due = F.col("planned_action").isin("create_object", "update_existing_module")
    skip = F.col("planned_action").isin(
        "adopt_existing", "skip_unchanged", "reprocess_changed", "reprocess_changed_blocked"
    )
    rows = plan.select(*KEY, due.cast("long").alias("due"), skip.cast("long").alias("skipped"))
    if failures is None:
        rows = rows.withColumn("failed", F.lit(0).cast("long"))
    else:
        bad = failures.select(*KEY).distinct().withColumn("_bad", F.lit(1).cast("long"))
        rows = rows.join(bad, KEY, "left").withColumn(
            "failed", F.coalesce(F.when(F.col("due") == 1, F.col("_bad")), F.lit(0))
        )
    zero = F.lit(0).cast("long")
    made = (F.col("action") == "create_schema").cast("long")
    parts = (
        rows.select(
            "database_name", (F.col("due") - F.col("failed")).alias("applied"),
            "skipped", "failed",
        )
        .unionByName(schemas.select(
            "database_name", made.alias("applied"), (1 - made).alias("skipped"),
            zero.alias("failed"),
        ))
        .unionByName(pending.select(
            "database_name", F.lit(1).cast("long").alias("applied"),
            zero.alias("skipped"), zero.alias("failed"),
        ))
    )
    return parts.groupBy("database_name").agg(
        F.sum("applied").alias("applied"),
        F.sum("skipped").alias("skipped"),
        F.sum("failed").alias("failed"),
    )


def run_outcome(
    plan: DataFrame,
    schemas: DataFrame,
    transitions: DataFrame,
    migrations: DataFrame,
    failures: DataFrame | None = None,
) -> DataFrame:
    """:func:`apply_outcome` with the pending change scripts counted in the same pass.

    ``transitions`` are the authored scripts, ``migrations`` the recorded ones; a script
    is pending where its table replays scripts and the log doesn't hold it.  The
    plan is joined on its own key only and evaluated once.
    """
    log = migrations.select("database_name", F.col("normalized_key").alias("path"))
    steps = transitions.join(log, ["database_name", "path"], "left_anti").groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_steps")
    )
    action, zero = F.col("planned_action"), F.lit(0).cast("long")
    due = action.isin("create_object", "update_existing_module")
    skip = action.isin(
        "adopt_existing", "skip_unchanged", "reprocess_changed", "reprocess_changed_blocked"
    )
    rows = plan.select(*KEY, "planned_action").join(steps, KEY, "left")
    failed = zero
    if failures is not None:
        bad = failures.select(*KEY).distinct().withColumn("_bad", F.lit(True))
        rows = rows.join(bad, KEY, "left")
        failed = F.when(due & F.col("_bad"), 1).otherwise(zero)
    replayed = F.when(action == "reprocess_changed", F.coalesce("_steps", zero)).otherwise(zero)
    made = (F.col("action") == "create_schema").cast("long")
    parts = rows.select(
        "database_name", (due.cast("long") - failed + replayed).alias("applied"),
        skip.cast("long").alias("skipped"), failed.alias("failed"),
    ).unionByName(schemas.select(
        "database_name", made.alias("applied"), (1 - made).alias("skipped"), zero.alias("failed"),
    ))
    return parts.groupBy("database_name").agg(
        *[F.sum(c).alias(c) for c in ("applied", "skipped", "failed")]
    )


def audit_rows_by_kind(history: DataFrame) -> DataFrame:
    return history.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def merge_plans(plans: list[DataFrame]) -> DataFrame:
    """Concatenate per-database plans; counts and verdicts then aggregate."""
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """Add up per-database summaries; ``blocked`` is true when any is."""
    return summaries.agg(
        *[F.sum(c).alias(c) for c in COUNT_COLUMNS],
        F.bool_or(F.col("blocked_count") > 0).alias("blocked"),
    )
