"""Release gate: comparing plans, timings and reports with a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reconcile.functions import text
from reconcile.functions.paths import snapshot_key
from reconcile.functions.scenarios import RISKY_ACTIONS
from reconcile.schemas import WORKFLOW_MS

SNAPSHOT_VERSION = "2"
# Fixed values.
TIMING_FACTOR = 3.0
TIMING_SLACK_MS = 100
SETUP_APPLY_MAX_MS = 500
#: Action of a snapshot row that names none; risky.
UNKNOWN_ACTION = "unknown"

_FIELDS = ["object_path", "planned_action", "checksum_hex", "exists"]


def plan_snapshot(plan: DataFrame) -> DataFrame:
    """Long snapshot rows of a plan."""
    return plan.select(
        snapshot_key(F.col("database_name"), F.col("normalized_key")).alias("snapshot_key"),
        "object_path",
        "planned_action",
        F.col("checksum").alias("checksum_hex"),
        "exists",
    )


def _paired(base: DataFrame, cur: DataFrame) -> DataFrame:
    b = base.select("snapshot_key", F.struct(*_FIELDS).alias("b"))
    c = cur.select("snapshot_key", F.struct(*_FIELDS).alias("c"))
    return b.join(c, "snapshot_key", "full_outer")


def snapshot_diff(base: DataFrame, cur: DataFrame) -> DataFrame:
    """Keys that differ, with the first difference found as ``reason``.

    NULL differs from every value, so a damaged side never compares as equal; an
    absent action is named ``unknown``.
    """
    def differs(f: str):
        return ~F.col(f"b.{f}").eqNullSafe(F.col(f"c.{f}"))

    action = {s: F.coalesce(F.col(f"{s}.planned_action"), F.lit(UNKNOWN_ACTION)) for s in "bc"}
    reason = (
        F.when(F.col("b").isNull(), action["c"])
        .when(F.col("c").isNull(), action["b"])
        .when(differs("planned_action"), action["c"])
        .when(differs("checksum_hex"), "checksum")
        .when(differs("exists"), "exists")
    )
    return _paired(base, cur).withColumn("reason", reason).filter(
        F.col("reason").isNotNull()
    ).select(
        "snapshot_key", "reason",
        F.when(F.col("c").isNotNull(), action["c"]).alias("current_action"),
    )


def compare_snapshots(
    base: DataFrame,
    cur: DataFrame,
    delta: DataFrame,
    strict: bool = True,
    *,
    versions: tuple[str, str] = (SNAPSHOT_VERSION, SNAPSHOT_VERSION),
    blocked: tuple[bool, bool] = (False, False),
) -> DataFrame:
    """Problem rows ``(category, snapshot_key, message)``; none means passed.

    Differences inside ``delta`` are expected unless the new action is risky;
    outside they are problems when ``strict``.  An empty delta therefore asks
    for an exact match.  ``versions`` and ``blocked`` are (baseline, current).
    """
    spark = base.sparkSession
    schema = "category string, snapshot_key string, message string"
    if versions[0] != versions[1]:
        msg = f"snapshot version mismatch: baseline={versions[0]} current={versions[1]}"
        return spark.createDataFrame([("version", None, msg)], schema)
    expected = delta.select("snapshot_key").distinct().withColumn("_in", F.lit(True))
    rows = snapshot_diff(base, cur).join(expected, "snapshot_key", "left")
    risky = F.col("current_action").isin([*RISKY_ACTIONS, UNKNOWN_ACTION])
    category = F.when(
        F.col("_in"), F.when(risky, "risky")
    ).when(F.lit(strict), "unexpected")
    message = F.when(
        F.col("category") == "risky",
        F.format_string("risky action for %s: %s", F.col("snapshot_key"), F.col("current_action")),
    ).otherwise(
        F.format_string("unexpected plan change outside delta: %s", F.col("snapshot_key"))
    )
    out = (
        rows.withColumn("category", category)
        .filter(F.col("category").isNotNull())
        .select("category", "snapshot_key", message.alias("message"))
    )
    if blocked[1] and not blocked[0]:
        out = out.unionByName(
            spark.createDataFrame([("blocked", None, "plan became blocked")], schema)
        )
    return out


def evaluate_gate(
    problems: DataFrame,
    delta: DataFrame,
    *,
    blocked: bool = False,
    plan_wall_ms: int = 0,
    max_plan_wall_ms: int = 0,
) -> DataFrame:
    """One verdict row; the messages stay in ``problems``.

    A ceiling of 0 switches the wall time check off; reaching it fails.
    """
    slow = max_plan_wall_ms > 0 and plan_wall_ms >= max_plan_wall_ms
    n_delta = delta.select("snapshot_key").distinct().agg(
        F.count(F.lit(1)).alias("delta_key_count")
    ).scalar()
    counts = problems.agg(
        F.count(F.lit(1)).alias("problems"),
        F.count_if(F.col("category") == "unexpected").alias("unexpected"),
        F.count_if(F.col("category") == "risky").alias("risky"),
    )
    slo = f"plan wall SLO exceeded: {plan_wall_ms}ms >= {max_plan_wall_ms}ms"
    return counts.select(
        ((F.col("problems") == 0) & F.lit(not blocked and not slow)).alias("passed"),
        "problems",
        "unexpected",
        "risky",
        F.lit(blocked).alias("plan_blocked"),
        F.lit(slo if slow else None).cast("string").alias("slo_message"),
        n_delta.alias("delta_key_count"),
    )


def snapshot_parity(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One message per missing key and per differing field."""

    def differs(f: str):
        e, a = F.col(f"b.{f}"), F.col(f"c.{f}")
        return F.when(
            F.col("b").isNotNull() & F.col("c").isNotNull() & ~e.eqNullSafe(a),
            F.format_string(
                f"%s {f}: baseline=%s actual=%s",
                F.col("snapshot_key"), e.cast("string"), a.cast("string"),
            ),
        )

    missing = F.when(
        F.col("b").isNull(),
        F.concat(F.lit("missing in baseline snapshot: "), "snapshot_key"),
    ).when(
        F.col("c").isNull(),
        F.concat(F.lit("missing in actual snapshot: "), "snapshot_key"),
    )
    found = F.filter(F.array(missing, *[differs(f) for f in _FIELDS]), lambda m: m.isNotNull())
    return _paired(expected, actual).select("snapshot_key", F.explode(found).alias("message"))


def _ceiling_message(factor: float, slack_ms: int):
    limit = text.ceiling_ms(F.col("baseline_ms"), factor, slack_ms)
    msg = F.format_string(
        "%s: actual=%dms > baseline=%dms ceiling=%dms "
        f"(factor={text.number_text(factor)}, slack={slack_ms}ms)",
        F.col("phase"), F.col("actual_ms"), F.col("baseline_ms"), limit,
    )
    return F.when(F.col("actual_ms") > limit, msg)


def pair_phases(base: DataFrame, cur: DataFrame) -> DataFrame:
    """Long (scenario, phase, ms) rows of two runs side by side, absent = 0."""
    on = ["scenario", "phase"]
    b = base.groupBy(*on).agg(F.sum("ms").alias("baseline_ms"))
    c = cur.groupBy(*on).agg(F.sum("ms").alias("actual_ms"))
    return b.join(c, on, "full_outer").select(
        *on,
        F.coalesce("baseline_ms", F.lit(0)).alias("baseline_ms"),
        F.coalesce("actual_ms", F.lit(0)).alias("actual_ms"),
    )


def timing_regressions(
    base: DataFrame,
    cur: DataFrame,
    factor: float = TIMING_FACTOR,
    slack_ms: int = TIMING_SLACK_MS,
) -> DataFrame:
    """Phases slower than ``ceil(base * factor) + slack``."""
    return pair_phases(base, cur).withColumn(
        "message", _ceiling_message(factor, slack_ms)
    ).filter(F.col("message").isNotNull())


def workflow_regressions(
    base: DataFrame,
    cur: DataFrame,
    factor: float = TIMING_FACTOR,
    slack_ms: int = TIMING_SLACK_MS,
) -> DataFrame:
    """As :func:`timing_regressions`, plus two rules: a phase the baseline
    measured must be measured again, and set-up has a hard cap."""
    cap = F.ceil(F.lit(SETUP_APPLY_MAX_MS * float(factor))) + F.lit(slack_ms)
    b, a = F.col("baseline_ms"), F.col("actual_ms")
    message = (
        F.when(
            (b > 0) & (a == 0),
            F.format_string("%s: baseline=%dms actual=0ms (missing measurement)", "phase", b),
        )
        .when(
            (F.col("phase") == "setup_apply_ms") & (a > cap),
            F.format_string("setup_apply_ms: actual=%dms exceeds hard max %dms", a, cap),
        )
        .otherwise(_ceiling_message(factor, slack_ms))
    )
    return pair_phases(base, cur).withColumn("message", message).filter(
        F.col("message").isNotNull()
    )


def workflow_phases(reports: DataFrame, names: list[str] = WORKFLOW_MS) -> DataFrame:
    """Long (scenario, phase, ms) rows of reports with a ``timings`` struct, absent = 0."""
    phases = F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(F.col(f"timings.{n}"), F.lit(0)))])
    return reports.select("scenario", F.explode(phases).alias("phase", "ms"))


# Compared fields by report kind: scalars, then lists, then masked path lists.
REPORT_FIELDS = {
    "plan": (["io.query_calls", "timings.l1_cache_hit"], ["setup_steps"], []),
    "apply": (
        ["applied", "failed", "skipped", "audit_object_rows", "audit_migration_rows",
         "catalog_meta_rows", "catalog_cache_rows"],
        ["errors", "setup_steps"], [],
    ),
    "gate": (["gate_pass"], ["messages"], []),
    "blocked": (["exit_code", "blocked"], ["blockers"], ["scaffold_paths"]),
}


def compare_reports(base: DataFrame, cur: DataFrame, kind: str) -> DataFrame:
    """One message per differing report field, joined on ``scenario``.

    Snapshots inside reports have their own operators, see
    ``sources.snapshots.explode_snapshots``.
    """
    scalars, lists, masked = REPORT_FIELDS[kind]
    b = base.select("scenario", F.struct(*[c for c in base.columns]).alias("b"))
    c = cur.select("scenario", F.struct(*[c for c in cur.columns]).alias("c"))

    def scalar(f):
        x, y = F.col(f"b.{f}"), F.col(f"c.{f}")
        return F.when(
            ~x.eqNullSafe(y),
            F.format_string(f"{f}: baseline=%s actual=%s", x.cast("string"), y.cast("string")),
        )

    def listed(f, mask=False):
        def norm(col):
            items = F.coalesce(col, F.array().cast("array<string>"))
            if not mask:
                return items
            return F.array_sort(F.transform(items, text.scaffold_identity))

        x, y = norm(F.col(f"b.{f}")), norm(F.col(f"c.{f}"))
        return F.when(
            x != y,
            F.format_string(
                f"{f}: baseline=%s actual=%s", text.quoted_list(x), text.quoted_list(y)
            ),
        )

    def path_label(name="timings.plan_db_path", given=F.lit(True)):
        x, y = F.col("b.timings.plan_db_path"), F.col("c.timings.plan_db_path")
        return F.when(
            given & (x != "") & ~x.eqNullSafe(y),
            F.format_string(f"{name}: baseline=%s actual=%s", x, F.coalesce(y, F.lit(""))),
        )

    def counts():
        none = F.create_map().cast("map<string,int>")
        x, y = (F.coalesce(F.col(f"{s}.action_counts"), none) for s in "bc")

        def as_text(m):
            items = F.array_sort(F.map_entries(m))
            return F.array_join(
                F.transform(items, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
            )

        return F.when(
            as_text(x) != as_text(y),
            F.concat(F.lit("action_counts: baseline="), as_text(x), F.lit(" actual="), as_text(y)),
        )

    both = F.col("b").isNotNull() & F.col("c").isNotNull()
    missing = F.when(F.col("b").isNull(), "missing in baseline").when(
        F.col("c").isNull(), "missing in actual"
    )
    checks = [scalar(f) for f in scalars]
    checks += [listed(f) for f in lists]
    checks += [listed(f, mask=True) for f in masked]
    if kind == "plan":
        checks += [path_label(), counts()]
    if kind in ("apply", "blocked") and "timings" in base.columns and "timings" in cur.columns:
        # An apply report without any measured time has no timings to compare.
        timed = [F.coalesce(F.col(f"{s}.timings.total_ms"), F.lit(0)) > 0 for s in "bc"]
        checks.append(path_label("plan_db_path", F.lit(True) if kind == "blocked" else timed[0] | timed[1]))
    checks = [F.when(both, x) for x in checks] + [missing]
    found = F.filter(F.array(*checks), lambda m: m.isNotNull())
    return b.join(c, "scenario", "full_outer").select(
        "scenario", F.explode(found).alias("message")
    )
