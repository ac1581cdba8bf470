"""Products that read the plan once, and rules of reports, layouts and empty databases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reconcile.operators import gate as gt, history as hs, products as pr, transitions as tr, validate as vd

K = "database_name string, normalized_key string"
PLAN = f"{K}, kind string, checksum string, planned_action string, blocked boolean"
ACTIONS = ["create_object", "update_existing_module", "adopt_existing", "skip_unchanged", "reprocess_changed", "reprocess_changed_blocked", "fail"]


def plan_rows(seed, blocked=True):
    rng = random.Random(seed)
    actions = ACTIONS if blocked else ACTIONS[:5]
    return [(f"d{i % 2}", f"k{i}", rng.choice(["tables", "views"]), f"c{i}", a := rng.choice(actions), a in ACTIONS[5:]) for i in range(60)]


@pytest.fixture
def stored(spark, tmp_path):
    def put(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    return put


def reads_of(df, folder):
    text = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return len(re.findall(rf"FileScan parquet [^\n]*{folder}", text))


def scripts(rng):
    steps = [("d0" if rng.random() < 0.7 else "d1", f"k{rng.randrange(60)}", f"p{i}", rng.choice([None, f"s{i}"])) for i in range(80)]
    return sorted(set(steps), key=repr)


def test_creation_records_read_the_plan_once(spark, stored, rows):
    plan = stored(plan_rows(1), PLAN, "plan")
    steps = scripts(random.Random(2))
    got = tr.creation_records(plan, spark.createDataFrame(steps, f"{K}, path string, checksum string"))
    made = {(r[0], r[1]): r for r in plan_rows(1) if r[4] == "create_object"}
    want = [(d, k, "object", r[3], "applied") for (d, k), r in made.items()]
    want += [(d, p, "migration", c or made[d, k][3], "applied") for d, k, p, c in steps if (d, k) in made and made[d, k][2] == "tables"]
    assert rows(got) == sorted(want, key=repr) and len(want) > len(made)
    assert reads_of(got, "plan") == 1


def test_metadata_records_read_the_plan_once_and_refuse(spark, stored, rows):
    plan = stored(plan_rows(3, blocked=False), PLAN, "plan")
    got = pr.metadata_records(plan)
    assert rows(got) == sorted([(r[0], r[1], "object", r[3], "adopted") for r in plan_rows(3, False) if r[4] == "adopt_existing"], key=repr)
    assert reads_of(got, "plan") == 1
    bad = stored(plan_rows(3), PLAN, "bad")
    for read in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("event").collect()):
        with pytest.raises(Exception, match="baseline refused"):
            read(pr.metadata_records(bad))
    assert pr.metadata_records(bad, "repair").count() == sum(r[4] not in ("create_object", "skip_unchanged") for r in plan_rows(3))


def test_run_outcome_equals_the_outcome_of_pending_scripts(spark, stored, rows):
    plan = stored(plan_rows(4), PLAN, "plan")
    schemas = spark.createDataFrame([("d0", "create_schema"), ("d0", "exists"), ("d1", "exists"), ("d9", "create_schema")], "database_name string, action string")
    steps = spark.createDataFrame(scripts(random.Random(5)), f"{K}, path string, checksum string")
    log = spark.createDataFrame([("d0", f"p{i}", "x") for i in range(0, 80, 3)], f"{K}, checksum string")
    bad = spark.createDataFrame([(f"d{i % 2}", f"k{i}") for i in range(0, 60, 4)] * 2, K)
    for failures in (None, bad):
        want = pr.apply_outcome(plan, schemas, tr.pending_transitions(plan, steps, log), failures)
        got = pr.run_outcome(plan, schemas, steps, log, failures)
        assert rows(got) == rows(want)
        assert reads_of(got, "plan") == 1


def test_script_paths_are_checked_level_by_level(spark):
    good = ["d/s/tables/_migrations/t/001_abcdef0_a.sql", "d/s/tables/_migrations/t/notes.sql", "d/s/views/v.sql", "d/x\\y/old/_migrations/t/a.sql"]
    bad = ["d/s\\x/tables/_migrations/t/001_abcdef0_a.sql", "d/s/tables/_migrations/../notes.sql", "d/s/tables/_migrations/t/a\\b.sql",
           "d//tables/_migrations/t/001_abcdef0_a.sql", "d/s/views/..sql", "d/s/tables/_migrations/t/\x00.sql"]
    got = vd.invalid_components(spark.createDataFrame([(p,) for p in good + bad], "path string"))
    assert {r.path for r in got.collect()} == set(bad)


def report(spark, rows):
    return spark.createDataFrame(rows, "scenario string, errors array<string>, setup_steps array<string>, timings struct<total_ms:long,plan_db_path:string>, exit_code int, blocked boolean, blockers array<string>, scaffold_paths array<string>")


def test_path_label_of_workflow_reports(spark, rows):
    def one(name, total, label):
        return (name, [], [], (total, label) if label is not None else None, 0, False, [], [])

    base = [one("timed", 5, "cold"), one("untimed", 0, "cold"), one("blank", 5, ""), one("same", 5, "cold"), one("gone", 5, "cold")]
    now = [one("timed", 0, "warm"), one("untimed", 0, "warm"), one("blank", 5, "warm"), one("same", 9, "cold"), one("gone", 5, None)]
    counts = ["applied", "failed", "skipped", "audit_object_rows", "audit_migration_rows", "catalog_meta_rows", "catalog_cache_rows"]
    full = [report(spark, r).withColumns({c: F.lit(1) for c in counts}) for r in (base, now)]
    assert rows(gt.compare_reports(*full, "apply")) == [
        ("gone", "plan_db_path: baseline=cold actual="), ("timed", "plan_db_path: baseline=cold actual=warm")]
    assert rows(gt.compare_reports(*full, "blocked")) == [
        ("gone", "plan_db_path: baseline=cold actual="), ("timed", "plan_db_path: baseline=cold actual=warm"),
        ("untimed", "plan_db_path: baseline=cold actual=warm")]


def test_empty_databases(spark, rows):
    databases = spark.createDataFrame([("a",), ("b",), ("b",)], "database_name string")
    some = spark.createDataFrame([("b", "k"), ("c", "k")], K)
    assert rows(hs.empty_databases(databases, some)) == [("a", True), ("b", False)]
    assert rows(hs.empty_databases(databases, some.limit(0))) == [("a", True), ("b", True)]
    assert rows(hs.empty_databases(databases.limit(0), some)) == []


def test_wanted_bits_let_every_wanted_string_through(spark):
    from reconcile.operators import scope as sp

    rng = random.Random(3)
    texts = sorted({"".join(rng.choices("ab/é.", k=rng.randrange(1, 9))) for _ in range(400)})
    wanted = set(rng.sample(texts, 60)) | {""}
    df = spark.createDataFrame([(t,) for t in texts + [""]], "path string")
    bits = sp._wanted_bits(spark.createDataFrame([(t,) for t in wanted], "path string"), "path")
    kept = {r.path for r in df.filter(sp._maybe(bits, F.col("path"))).collect()}
    assert wanted <= kept and len(kept) < len(wanted) + 5
    none = sp._wanted_bits(df.limit(0), "path")
    assert df.filter(sp._maybe(none, F.col("path"))).collect() == []


def test_names_of_proposal_files(spark, rows):
    from reconcile.functions import paths
    from reconcile.operators import evolution as ev

    texts = spark.createDataFrame([("d", "s/tables/t", "x"), ("d", "s/tables/u", "y")], f"{K}, content string")
    there = spark.createDataFrame([("d/s/tables/_migrations/u/001_abcdef0_auto_add_columns.sql",)], "path string")
    got = ev.proposal_files(texts, "abcdef0", there)
    assert rows(got, "path", "content") == [("d/s/tables/_migrations/t/001_abcdef0_auto_add_columns.sql", "x")]
    # the names read back as change scripts of their table
    t = got.select(paths.parse_transition(F.col("path")).alias("t")).first().t
    assert (t.normalized_key, t.ordinal, t.commit, t.slug) == ("s/tables/t", "001", "abcdef0", "auto_add_columns")
    assert ev.proposal_files(texts, "../x").collect() == []
    assert rows(ev.template_files(texts, "../x"), "path")[0] == ("d/s/tables/_migrations/t/001_0000000_describe_change.sql",)
