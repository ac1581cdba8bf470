"""One row per rung of the decision ladders."""

import pytest
from pyspark.sql import functions as F

from reconcile.functions import scenarios as sc
from reconcile.functions.checksums import ZERO_DIGEST
from reconcile.operators import drift as dr, gate, products as pr, transitions as tr
from reconcile.plans.execution import prepare_execution
from reconcile.plans.reconciliation import compute_plan, resolve_scenario

A, B = "a" * 64, "b" * 64

FACTS = ("exists boolean, prior string, checksum string, drift boolean, kind string, "
         "transitions bigint, parent_name string, parent_managed boolean, "
         "parent_exists boolean, parent_prior string, parent_label string, normalized_key string")

# exists, prior, checksum, drift, kind, transitions, parent, managed, p.exists, p.prior -> scenario
RUNGS = [
    (False, None, A, False, "tables", 0, None, False, None, None, "create"),
    (False, A, A, True, "views", 0, None, False, None, None, "create"),
    (True, None, A, False, "views", 0, None, False, None, None, "adopt"),
    (True, ZERO_DIGEST, A, True, "views", 0, None, False, None, None, "adopt"),
    (True, "", A, False, "views", 0, None, False, None, None, "adopt"),
    (True, A, A, True, "views", 0, None, False, None, None, "module_update"),
    (True, B, A, True, "triggers", 0, "t", False, None, None, "module_update"),
    (True, A, A, True, "tables", 3, None, False, None, None, "live_structural_drift_blocked"),
    (True, A, A, False, "tables", 0, None, False, None, None, "skip_unchanged"),
    (True, A, A, False, "triggers", 0, "t", False, None, None, "skip_unchanged"),
    (True, B, A, False, "tables", 0, None, False, None, None, "table_blocked_no_transitions"),
    (True, B, A, False, "tables", 1, None, False, None, None, "table_reprocess"),
    (True, B, A, False, "triggers", 0, None, False, None, None, "module_update"),
    (True, B, A, False, "triggers", 0, "", False, None, None, "module_update"),
    (True, B, A, False, "triggers", 0, "t", False, None, None, "trigger_blocked_parent_missing"),
    (True, B, A, False, "triggers", 0, "t", True, False, A, "trigger_blocked_parent_missing"),
    (True, B, A, False, "triggers", 0, "t", True, True, None, "trigger_blocked_parent_changing"),
    (True, B, A, False, "triggers", 0, "t", True, True, ZERO_DIGEST,
     "trigger_blocked_parent_changing"),
    (True, B, A, False, "triggers", 0, "t", True, True, A, "trigger_update_module"),
    (True, B, A, False, "procedures", 0, None, False, None, None, "module_update"),
    (True, B, A, False, "indexes", 0, None, False, None, None, "structural_change_blocked"),
    (True, B, A, False, "queues", 0, None, False, None, None, "structural_change_blocked"),
]


def test_scenario_rungs(spark):
    data = [(*r[:10], r[6], f"s/{r[4]}/o{i}") for i, r in enumerate(RUNGS)]
    got = resolve_scenario(spark.createDataFrame(data, FACTS)).collect()
    by_key = {r.normalized_key: r for r in got}
    for i, r in enumerate(RUNGS):
        row = by_key[f"s/{r[4]}/o{i}"]
        assert row.scenario == r[10], (r, row.scenario)
        assert row.planned_action == sc.ACTIONS[r[10]]
        assert row.blocked == (r[10] in sc.BLOCKED) == (row.message is not None)
        assert row.needs_provenance == (r[10] != "skip_unchanged")
    assert {r[10] for r in RUNGS} == set(sc.ACTIONS)


def test_messages(spark):
    data = [(True, B, A, False, "triggers", 0, "T1", False, None, None, None, "s/triggers/x")]
    row = resolve_scenario(spark.createDataFrame(data, FACTS)).first()
    assert row.message == "trigger s/triggers/x parent table ? not found"


# kind, checksum, recorded, suspect, live -> drift
DRIFT = [
    ("queues", A, None, True, None, False),
    ("views", None, None, True, None, False),
    ("views", "", None, True, None, False),
    ("views", "abc", None, True, None, False),
    ("views", ZERO_DIGEST, None, True, None, False),
    ("views", A, None, False, A, True),
    ("views", A, A, False, B, False),
    ("views", A, A, True, None, True),
    ("views", A, A, True, B, True),
    ("views", A, A, True, A, False),
]


def test_drift_rungs(spark):
    data = [(i, *r) for i, r in enumerate(DRIFT)]
    df = spark.createDataFrame(
        data, "i int, kind string, checksum string, recorded string, suspect boolean, live string, "
              "want boolean")
    flag = sc.drift_flag(*[F.col(c) for c in ("kind", "checksum", "recorded", "suspect", "live")])
    for r in df.withColumn("got", flag).collect():
        assert r.got == r.want, r


def test_suspects(spark, rows):
    latest = spark.createDataFrame(
        [("d", "a", 5), ("d", "b", 5), ("d", "c", 5), ("d", "e", None)],
        "database_name string, normalized_key string, applied_ddl_version bigint")
    ddl = spark.createDataFrame(
        [("d", "a", 6), ("d", "b", 5), ("x", "c", 9)],
        "database_name string, normalized_key string, ddl_version bigint")
    got = rows(dr.suspects(latest, ddl), "normalized_key", "suspect")
    assert got == [("a", True), ("b", False), ("c", False), ("e", True)]
    assert all(s for _, s in rows(dr.suspects(latest, ddl, True), "normalized_key", "suspect"))


def _plan_inputs(spark):
    keys = "database_name string, normalized_key string"
    m = [("d", f"s/{k}/{n}", f"d/s/{k}/{n}.sql", "s", k, n, c) for k, n, c in [
        ("tables", "t1", B), ("tables", "t2", A), ("triggers", "tr1", B), ("triggers", "tr2", B),
        ("views", "v1", A), ("views", "v2", B), ("tables", "new", A),
    ]]
    manifest = spark.createDataFrame(
        m, keys + ", object_path string, schema_name string, kind string, object_name string, "
                  "checksum string")
    catalog = spark.createDataFrame(
        [("d", "s/tables/t1", ""), ("d", "s/tables/t2", None), ("d", "s/triggers/tr1", "T1"),
         ("d", "s/triggers/tr2", "gone"), ("d", "s/views/v1", ""), ("d", "s/views/v2", ""),
         ("d", "s/views/v2", "")], keys + ", parent_name string")
    log = [("d", k, "object", A, A, 1, "applied") for k in (
        "s/tables/t1", "s/triggers/tr1", "s/triggers/tr2", "s/views/v1", "s/views/v2")]
    history = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(log)],
        "id bigint, " + keys + ", kind string, checksum string, live_definition_checksum string, "
                               "applied_ddl_version bigint, event string")
    ddl = spark.createDataFrame([("d", "s/views/v1", 7)], keys + ", ddl_version bigint")
    steps = spark.createDataFrame(
        [("d", "s/tables/t1", "001", "p1", A), ("d", "s/tables/t1", "002", "p2", B),
         ("d", "s/tables/new", "001", "p3", A)],
        keys + ", ordinal string, path string, checksum string")
    live = spark.createDataFrame([("d", "s/views/v1", B)], keys + ", live_checksum string")
    return manifest, catalog, history, ddl, steps, live


def test_plan_and_execution(spark, rows):
    manifest, catalog, history, ddl, steps, live = _plan_inputs(spark)
    asked = []

    def fingerprints(keys):
        asked.append(keys)
        return live.join(keys, ["database_name", "normalized_key"], "left_semi")

    plan = compute_plan(manifest, catalog, history, ddl, steps, fingerprints)
    assert rows(plan, "normalized_key", "scenario") == [
        ("s/tables/new", "create"), ("s/tables/t1", "table_reprocess"), ("s/tables/t2", "adopt"),
        ("s/triggers/tr1", "trigger_update_module"),
        ("s/triggers/tr2", "trigger_blocked_parent_missing"),
        ("s/views/v1", "module_update"), ("s/views/v2", "module_update"),
    ]
    assert rows(asked[0]) == [("d", "s/views/v1")]

    log = spark.createDataFrame(
        [(1, "d", "p1", "migration", B, "applied"), (2, "d", "p2", "migration", " ", "applied")],
        "id bigint, database_name string, normalized_key string, kind string, checksum string, "
        "event string")
    work = prepare_execution(plan, steps, log)
    assert rows(work["refused_adoptions"], "normalized_key") == [("s/tables/t2",)]
    assert rows(work["tampered"], "path") == [("p1",)]
    assert rows(work["pending"], "path") == []
    order = [r.normalized_key for r in work["deploy"].collect()]
    assert order == ["s/tables/new", "s/views/v1", "s/views/v2", "s/triggers/tr1"]
    assert rows(work["records"], "normalized_key", "kind") == [
        ("p3", "migration"), ("s/tables/new", "object")]


def test_undecodable_checksum(spark, rows):
    manifest, catalog, history, ddl, steps, live = _plan_inputs(spark)
    bad = history.withColumn("checksum", F.when(
        F.col("normalized_key") == "s/views/v2", "zz").otherwise(F.col("checksum")))
    with pytest.raises(Exception, match="checksum for s/views/v2 is undecodable"):
        compute_plan(manifest, catalog, bad, ddl, steps, live).collect()
    fixed = compute_plan(manifest, catalog, bad, ddl, steps, live, repair=True)
    assert dict(rows(fixed, "normalized_key", "scenario"))["s/views/v2"] == "adopt"
    # A log row of an unmanaged key is never decoded.
    others = manifest.filter("normalized_key <> 's/views/v2'")
    assert compute_plan(others, catalog, bad, ddl, steps, live).count() == 6


def plan_oracle(manifest, catalog, history, ddl, steps, live):
    """The plan as nested loops over small lists."""
    cat = {}
    for db, key, parent in catalog:
        cat[(db, key)] = max(cat.get((db, key)) or "", parent or "") or None
    last = {}
    for i, db, key, kind, checksum, recorded, version, event in sorted(history):
        if kind == "object" and event in ("applied", "adopted"):
            last[(db, key)] = (checksum, recorded, version)
    out = {}
    for db, key, _, schema, kind, _, checksum in manifest:
        k = (db, key)
        sums, recorded, version = last.get(k, (None, None, None))
        prior = sums or None
        drift = False
        if prior:
            suspect = version is None or ddl.get(k, 0) > version
            drift = recorded is None or (suspect and live.get(k) != recorded)
        module = kind in ("views", "triggers")
        if k not in cat:
            out[k] = "create"
        elif not prior:
            out[k] = "adopt"
        elif drift:
            out[k] = "module_update" if module else "live_structural_drift_blocked"
        elif prior == checksum:
            out[k] = "skip_unchanged"
        elif kind == "tables":
            out[k] = "table_reprocess" if k in steps else "table_blocked_no_transitions"
        elif kind == "triggers" and cat[k]:
            p = (db, f"{schema}/tables/{cat[k].lower()}")
            managed = any(m[:2] == p for m in manifest)
            if not managed or p not in cat:
                out[k] = "trigger_blocked_parent_missing"
            elif not last.get(p, ("",))[0]:
                out[k] = "trigger_blocked_parent_changing"
            else:
                out[k] = "trigger_update_module"
        else:
            out[k] = "module_update" if module else "structural_change_blocked"
    return out


@pytest.mark.parametrize("seed", range(4))
def test_plan_against_brute_force(spark, seed):
    """Random tables with a hot parent and a hot log key, with and without broadcasts."""
    import random

    rng = random.Random(seed)
    sums = [A, B, ""]
    keys = [(f"d{i % 2}", f"s/{k}/o{i}", f"d{i % 2}/s/{k}/o{i}.sql", "s", k, f"o{i}", rng.choice([A, B]))
            for i in range(120) for k in [rng.choice(["tables", "views", "triggers", "indexes"])]]
    parents = ["O0", "O1", None, "", "gone"] + [f"o{i}" for i in range(120)]
    catalog = [(m[0], m[1], rng.choice(parents[:5] if rng.random() < 0.5 else parents))
               for m in keys if rng.random() < 0.85]
    catalog += rng.sample(catalog, 5)
    history = []
    for i in range(600):
        m = keys[0] if rng.random() < 0.33 else rng.choice(keys)
        history.append((i, m[0], m[1], "object", rng.choice(sums), rng.choice([A, B, None, A]),
                        rng.choice([None, 5, 10]), rng.choice(["applied", "adopted", "failed"])))
    ddl = {m[:2]: rng.choice([1, 7, 12]) for m in keys if rng.random() < 0.6}
    live = {m[:2]: rng.choice([A, B]) for m in keys if rng.random() < 0.8}
    steps = {m[:2] for m in keys if m[4] == "tables" and rng.random() < 0.5}
    k = "database_name string, normalized_key string"
    frames = [
        spark.createDataFrame(keys, k + ", object_path string, schema_name string, kind string, "
                                        "object_name string, checksum string"),
        spark.createDataFrame(catalog, k + ", parent_name string"),
        spark.createDataFrame(history, "id bigint, " + k + ", kind string, checksum string, "
                              "live_definition_checksum string, applied_ddl_version bigint, event string"),
        spark.createDataFrame([(*x, v) for x, v in ddl.items()], k + ", ddl_version bigint"),
        spark.createDataFrame([(*x, "001") for x in steps], k + ", ordinal string"),
        spark.createDataFrame([(*x, v) for x, v in live.items()], k + ", live_checksum string"),
    ]
    want = plan_oracle(keys, catalog, history, ddl, steps, live)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names if seed % 2 else []:
        spark.conf.set(name, "-1")
    try:
        rows = compute_plan(*frames).collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert {(r.database_name, r.normalized_key): r.scenario for r in rows} == want
    assert len(rows) == len(keys)


def test_latest_state_replaces_history(spark, rows):
    from reconcile.operators import history as hs

    manifest, catalog, history, ddl, steps, live = _plan_inputs(spark)
    a = compute_plan(manifest, catalog, history, ddl, steps, live)
    b = compute_plan(manifest, catalog, None, ddl, steps, live,
                     latest=hs.latest_object_history(history))
    assert rows(a, "normalized_key", "scenario") == rows(b, "normalized_key", "scenario")


def test_baseline_refused_when_blocked(spark):
    plan = compute_plan(*_plan_inputs(spark))
    with pytest.raises(Exception, match="baseline refused"):
        pr.metadata_records(plan, "baseline").collect()
    assert pr.metadata_records(plan, "repair").count() == 6
    with pytest.raises(ValueError):
        pr.metadata_records(plan, "other")


def test_duplicate_ordinal_fails(spark):
    steps = spark.createDataFrame(
        [("d", "k", "001", "a"), ("d", "k", "001", "b")],
        "database_name string, normalized_key string, ordinal string, path string")
    with pytest.raises(Exception, match="duplicate transition ordinal 001 for k"):
        tr.transition_lists(steps).collect()


SNAP = ("snapshot_key string, object_path string, planned_action string, checksum_hex string, "
        "exists boolean")


def _snap(spark, *data):
    return spark.createDataFrame(list(data), SNAP)


def test_gate_rungs(spark, rows):
    base = _snap(spark, ("same", "p", "skip_unchanged", A, True),
                 ("gone", "p", "skip_unchanged", A, True), ("act", "p", "skip_unchanged", A, True),
                 ("sum", "p", "skip_unchanged", A, True), ("ex", "p", "skip_unchanged", A, True),
                 ("path", "p", "skip_unchanged", A, True))
    cur = _snap(spark, ("same", "p", "skip_unchanged", A, True),
                ("new", "p", "create_object", A, False), ("act", "p", "fail", B, True),
                ("sum", "p", "skip_unchanged", B, False), ("ex", "p", "skip_unchanged", A, False),
                ("path", "q", "skip_unchanged", A, True))
    assert rows(gate.snapshot_diff(base, cur), "snapshot_key", "reason") == [
        ("act", "fail"), ("ex", "exists"), ("gone", "skip_unchanged"), ("new", "create_object"),
        ("sum", "checksum")]
    none = spark.createDataFrame([], "snapshot_key string")
    # An empty delta asks for an exact match.
    assert gate.compare_snapshots(base, cur, none).count() == 5
    assert gate.compare_snapshots(base, cur, none, strict=False).count() == 0
    delta = spark.createDataFrame([("act",), ("sum",), ("new",)], "snapshot_key string")
    got = rows(gate.compare_snapshots(base, cur, delta), "category", "snapshot_key")
    assert got == [("risky", "act"), ("unexpected", "ex"), ("unexpected", "gone")]
    got = rows(gate.compare_snapshots(base, cur, delta, versions=("1", "2")), "category", "message")
    assert got == [("version", "snapshot version mismatch: baseline=1 current=2")]
    got = gate.compare_snapshots(base, base, none, blocked=(False, True)).first()
    assert got.message == "plan became blocked"
    assert rows(gate.snapshot_parity(base, cur).filter("snapshot_key = 'path'"), "message") == [
        ("path object_path: baseline=p actual=q",)]


@pytest.mark.parametrize("wall,limit,blocked,want", [
    (0, 0, False, True), (499, 500, False, True), (500, 500, False, False),
    (9999, 0, False, True), (0, 0, True, False),
])
def test_gate_verdict(spark, wall, limit, blocked, want):
    base = _snap(spark, ("k", "p", "skip_unchanged", A, True))
    none = spark.createDataFrame([], "snapshot_key string")
    problems = gate.compare_snapshots(base, base, none)
    row = gate.evaluate_gate(
        problems, none, blocked=blocked, plan_wall_ms=wall, max_plan_wall_ms=limit).first()
    assert row.passed is want and row.delta_key_count == 0


def test_workflow_rules(spark, rows):
    cols = "scenario string, phase string, ms bigint"
    base = spark.createDataFrame([("s", "setup_apply_ms", 1000), ("s", "plan_wall_ms", 10),
                                  ("s", "total_ms", 10), ("s", "migrate_wall_ms", 0)], cols)
    cur = spark.createDataFrame([("s", "setup_apply_ms", 1601), ("s", "plan_wall_ms", 0),
                                 ("s", "total_ms", 131), ("s", "migrate_wall_ms", 0)], cols)
    got = dict(rows(gate.workflow_regressions(base, cur), "phase", "message"))
    assert got == {
        "setup_apply_ms": "setup_apply_ms: actual=1601ms exceeds hard max 1600ms",
        "plan_wall_ms": "plan_wall_ms: baseline=10ms actual=0ms (missing measurement)",
        "total_ms": "total_ms: actual=131ms > baseline=10ms ceiling=130ms (factor=3, slack=100ms)",
    }
    assert rows(gate.timing_regressions(base, cur), "phase") == [("total_ms",)]


def test_apply_outcome_failures(spark, rows):
    plan = compute_plan(*_plan_inputs(spark))
    schemas = spark.createDataFrame(
        [("d", "s", "create_schema"), ("d", "u", "exists")],
        "database_name string, schema_name string, action string")
    pending = spark.createDataFrame([("d", "s/tables/t1", "p2")],
                                    "database_name string, normalized_key string, path string")
    failures = spark.createDataFrame([("d", "s/views/v1"), ("d", "s/tables/t2")],
                                     "database_name string, normalized_key string")
    got = rows(pr.apply_outcome(plan, schemas, pending, failures))
    # new, tr1, v2, the schema and the step ran; t1, t2, tr2 and a schema were skipped.
    assert got == [("d", 5, 4, 1)]


def test_kind_must_be_known_to_the_ladder():
    assert set(sc.BLOCKED) <= set(sc.ACTIONS)
