"""Explicit schemas of the logical tables and of the JSON wire formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


HISTORY = _struct(
    ("id", L), ("database_name", S), ("normalized_key", S), ("kind", S),
    ("checksum", S), ("live_definition_checksum", S), ("applied_ddl_version", L),
    ("git_hash", S), ("git_author", S), ("git_date", T.TimestampType()),
    ("event", S), ("error_text", S), ("created_at", T.TimestampType()),
)

CATALOG = _struct(
    ("row_kind", S), ("database_name", S), ("schema_name", S), ("kind", S),
    ("object_name", S), ("parent_name", S),
)

SNAPSHOT_OBJECT = _struct(
    ("object_path", S), ("planned_action", S), ("checksum_hex", S), ("exists", B),
)
SNAPSHOT_DOC = _struct(
    ("version", S), ("blocked", B), ("objects", T.MapType(S, SNAPSHOT_OBJECT)),
)

PLAN_OBJECT = _struct(
    ("normalizedKey", S), ("objectPath", S), ("schemaName", S), ("kind", S),
    ("objectName", S), ("databaseName", S), ("parentName", S),
    ("transitionPaths", T.ArrayType(S)), ("gitHash", S), ("gitAuthor", S),
    ("gitDate", S), ("checksum", S), ("plannedAction", S), ("exists", B),
)
PLAN_SUMMARY = _struct(
    ("schemaCount", L), ("objectCount", L), ("createCount", L), ("adoptCount", L),
    ("skipCount", L), ("changedCount", L), ("blockedCount", L),
)
PLAN_DOC = _struct(
    ("command", S), ("plannedAt", S), ("blocked", B), ("blockers", T.ArrayType(S)),
    ("schemas", T.ArrayType(_struct(("action", S), ("schemaName", S)))),
    ("objects", T.ArrayType(PLAN_OBJECT)), ("summary", PLAN_SUMMARY),
)

PHASE_MS = [
    "connect_ms", "scan_ms", "inspect_ms", "checksums_ms", "ensure_ms",
    "parallel_wall_ms", "audit_ms", "diff_ms", "plan_wall_ms", "cli_wall_ms",
    "engine_ms", "apply_ms", "plan_db_query_calls", "plan_db_query_ms",
    "plan_db_checksums_batch_ms", "plan_db_catalog_ms", "plan_db_catalog_sql_ms",
    "plan_db_intern_catalog_ms", "plan_db_round_trips",
]
PHASE_FLAGS = [
    "l1_cache_hit", "plan_db_bootstrap", "plan_db_catalog_queried",
    "plan_db_history_empty", "plan_db_checksums_skipped",
]
PHASE_TIMINGS = _struct(
    *[(c, L) for c in PHASE_MS], ("plan_db_path", S), *[(c, B) for c in PHASE_FLAGS]
)
IO_COUNTERS = _struct(
    ("query_ms", L), ("query_calls", L), ("exec_ms", L), ("exec_calls", L)
)
WORKFLOW_MS = [
    "setup_apply_ms", "plan_parallel_wall_ms", "plan_wall_ms",
    "migrate_parallel_wall_ms", "migrate_wall_ms", "total_ms",
]
WORKFLOW_TIMINGS = _struct(*[(c, L) for c in WORKFLOW_MS], ("plan_db_path", S))

# Report documents by kind; the listed fields must be JSON objects.
REPORTS = {
    "plan": (
        _struct(("scenario", S), ("setup_steps", T.ArrayType(S)),
                ("timings", PHASE_TIMINGS), ("io", IO_COUNTERS),
                ("snapshot", SNAPSHOT_DOC), ("action_counts", T.MapType(S, I))),
        ["timings", "io", "snapshot", "action_counts"],
    ),
    "apply": (
        _struct(("scenario", S), ("setup_steps", T.ArrayType(S)), ("applied", I),
                ("failed", I), ("skipped", I), ("errors", T.ArrayType(S)),
                ("audit_object_rows", I), ("audit_migration_rows", I),
                ("catalog_meta_rows", I), ("catalog_cache_rows", I),
                ("timings", WORKFLOW_TIMINGS)),
        ["timings"],
    ),
    "gate": (
        _struct(("scenario", S), ("setup_steps", T.ArrayType(S)), ("gate_pass", B),
                ("messages", T.ArrayType(S)), ("snapshot", SNAPSHOT_DOC)),
        ["snapshot"],
    ),
    "blocked": (
        _struct(("scenario", S), ("setup_steps", T.ArrayType(S)), ("exit_code", I),
                ("blocked", B), ("blockers", T.ArrayType(S)),
                ("scaffold_paths", T.ArrayType(S)), ("timings", WORKFLOW_TIMINGS)),
        ["timings"],
    ),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto ``schema``; a column the input lacks reads as NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
