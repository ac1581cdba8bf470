"""Sources, sinks and streams on files written for the test."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from reconcile.operators import history as hs, validate as vd
from reconcile.sources import (
    catalog as sc, commits as cm, history as sh, plan_json as pj, reports as rp, snapshots as ss, tree,
)
from reconcile.streaming import changes as ch, tail

KEYS = "database_name string, normalized_key string"


def write(root, files):
    for path, data in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data.encode() if isinstance(data, str) else data)


@pytest.fixture
def script_tree(tmp_path):
    mark = "-- transition-scaffold\n"
    write(tmp_path, {
        "db/S/tables/T1.SQL": "CREATE TABLE t (a INT)\r\n",
        "db/S/tables/t2.sql": b"\xff\xfe binary",
        "db/S/tables/_migrations/T1/001_abcdef0_one.sql": "ALTER",
        "db/S/tables/_migrations/T1/002_abcdef0_two.sql": mark,
        "db/S/tables/_migrations/T1/notes.sql": "x",
        "db/checks/c.sql": "SELECT 1", "db/S/old/tables/x.sql": "x", "db/S/widgets/w.sql": "x",
        "db/a/b/c/d/e/_f/_g/views/z.sql": "x",
        "db/S/tables/readme.md": "no", ".hidden/s/tables/t.sql": "x", "top/only.sql": "x",
    })
    return tmp_path


def test_scan_tree(spark, rows, script_tree):
    files = tree.scan_tree(spark, str(script_tree))
    got = dict(rows(tree.classify_paths(files), "path", "script_kind"))
    assert got["db/S/tables/T1.SQL"] == "object"
    assert got["db/S/tables/_migrations/T1/001_abcdef0_one.sql"] == "transition"
    assert got["db/S/tables/_migrations/T1/notes.sql"] == "ignored"
    assert "db/a/b/c/d/e/_f/_g/views/z.sql" in got
    assert len(got) == 11 and ".hidden/s/tables/t.sql" in got
    assert "db/S/tables/readme.md" not in got
    m = {r.normalized_key: r for r in tree.manifest_of(files.filter("path like 'db/%'")).collect()}
    import hashlib
    assert m["s/tables/t1"].checksum == hashlib.sha256(b"CREATE TABLE t (a INT)\n").hexdigest()
    assert m["s/tables/t2"].checksum == hashlib.sha256(b"\xff\xfe binary").hexdigest()
    assert rows(tree.transitions_of(files), "normalized_key", "ordinal") == [("s/tables/t1", "001")]
    assert rows(tree.discover_databases(files), "database_name") == [("db",)]
    assert rows(vd.layout_violations(files), "path", "severity") == [
        ("db/S/old/tables/x.sql", "error"), ("db/S/widgets/w.sql", "warning"),
        ("db/a/b/c/d/e/_f/_g/views/z.sql", "error")]
    with pytest.raises(ValueError):
        tree.require_databases(files.filter("path like 'top/%'"))


def test_commit_log_in_splits(spark, tmp_path):
    lines, want, path = [], {}, tmp_path / "log.txt"
    for c in range(200):
        lines.append(f"COMMIT\x1fh{c}\x1fA | B\x1f2024-01-01")
        lines.append("")
        for i in range(c % 7):
            p = f"db\\p{(c * 5 + i) % 40}.sql"
            lines.append(p)
            want.setdefault(p.replace("\\", "/"), f"h{c}")
    path.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        from reconcile.operators.provenance import latest_commit_per_path
        touches = cm.read_commit_log(spark, str(path))
        assert touches.select("block").distinct().count() > 1
        got = {r.object_path: r.git_hash
               for r in latest_commit_per_path(touches, ["block", "line_no"]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def plan_doc(checksum):
    return {"plannedAt": "now", "blocked": False, "schemas": [], "objects": [{
        "normalizedKey": "s/views/v", "objectPath": "db/s/views/v.sql", "schemaName": "s",
        "kind": "views", "objectName": "v", "checksum": checksum, "plannedAction": "create_object",
        "exists": False, "gitHash": "h"}], "summary": {"objectCount": 1}}


def test_plan_documents(spark, tmp_path):
    good = base64.b64encode(bytes(range(32))).decode()
    (tmp_path / "plan.json").write_text(json.dumps(plan_doc(good), indent=2))
    row = pj.read_plans(spark, str(tmp_path / "plan.json")).first()
    assert row.checksum == bytes(range(32)).hex() and row.git_hash == "h"
    assert row.database_name == "" and row.transition_paths is None
    for bad in (base64.b64encode(b"short").decode(), "***", None):
        (tmp_path / "bad.json").write_text(json.dumps(plan_doc(bad)))
        with pytest.raises(Exception, match="checksum must be 32 bytes"):
            pj.read_plans(spark, str(tmp_path / "bad.json")).collect()


PLAN = KEYS + (", object_path string, schema_name string, kind string, object_name string, "
               "parent_name string, checksum string, planned_action string, exists boolean, "
               "blocked boolean, counter string, message string, transition_paths array<string>")


def plan_rows(spark):
    return spark.createDataFrame(
        [("d", "s/views/v", "p", "s", "views", "v", None, "ab" * 32, "create_object", False, False,
          "create", None, []),
         ("d", "s/tables/t", "q", "s", "tables", "t", "x", "cd" * 32, "fail", True, True, "changed",
          "no way", ["m1"])], PLAN)


def test_plan_writers(spark, tmp_path, rows):
    plan = plan_rows(spark)
    pj.write_plans(plan, str(tmp_path / "lines"))
    text = "".join(p.read_text() for p in (tmp_path / "lines/objects").glob("*.json"))
    docs = [json.loads(x) for x in text.splitlines()]
    view = next(d for d in docs if d["kind"] == "views")
    assert "parentName" not in view and "transitionPaths" not in view and view["checksum"].endswith("=")
    assert pj.read_plans(spark, str(tmp_path / "lines"), "lines").count() == 2
    schemas = spark.createDataFrame([("d", "s", "exists")],
                                    "database_name string, schema_name string, action string")
    pj.write_plan_documents(plan, schemas, str(tmp_path / "doc"))
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "doc/doc=d").glob("*.txt"))))
    assert doc["blocked"] and doc["blockers"] == ["no way"]
    assert [o["normalizedKey"] for o in doc["objects"]] == ["s/tables/t", "s/views/v"]
    assert doc["summary"]["blockedCount"] == 1 and doc["schemas"] == [
        {"action": "exists", "schemaName": "s"}]


def test_run_report_drops_stale_plan(spark, tmp_path):
    path = str(tmp_path / "run")
    rp.write_run_report(spark, path, "plan", 0, plan_rows(spark))
    assert pj.read_plans(spark, f"{path}/plan", "lines").count() == 2
    rp.write_run_report(spark, path, "migrate", 3)
    assert pj.read_plans(spark, f"{path}/plan", "lines").count() == 0
    row = spark.read.json(f"{path}/report").first()
    assert (row.command, row.result, row.exitCode) == ("migrate", "failure", 3)


def test_snapshot_layouts(spark, tmp_path, rows):
    snap = spark.createDataFrame([("k1", "p", "fail", "c", True), ("k2", "q", "skip", "d", False)],
                                 "snapshot_key string, object_path string, planned_action string, "
                                 "checksum_hex string, exists boolean")
    ss.write_snapshots(snap, str(tmp_path / "lines"), blocked=True)
    ss.write_snapshot_document(snap, str(tmp_path / "doc"))
    a = rows(ss.read_snapshots(spark, str(tmp_path / "lines"), "lines"))
    b = rows(ss.read_snapshots(spark, str(tmp_path / "doc"), "parts").drop("version", "blocked"))
    assert a == b == rows(snap)
    assert ss.read_header(spark, str(tmp_path / "lines")).first().blocked


def test_reports(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"scenario": "a", "applied": 2, "timings": {"total_ms": 5}}))
    bad.write_text(json.dumps({"scenario": "b", "timings": "x"}))
    assert rp.read_reports(spark, str(good), "apply").first().timings.total_ms == 5
    with pytest.raises(Exception):
        rp.read_reports(spark, str(bad), "apply").collect()
    rows = rp.read_reports(spark, str(tmp_path / "*.json"), "apply", strict=False).collect()
    assert sorted(r._corrupt_record is not None for r in rows) == [False, True]
    texts = spark.createDataFrame([("[1]",), ("nope",), ('{"snapshot": 1}',), ("{}",)], "value string")
    got = {r.value: r.reason for r in rp.shape_errors(texts, "gate").collect()}
    assert got == {"[1]": "report JSON must be an object", "nope": "report JSON must be an object",
                   '{"snapshot": 1}': "report field `snapshot` must be an object"}


def test_history_log(spark, tmp_path):
    path = str(tmp_path / "log")
    cols = KEYS + ", kind string, checksum string, live_definition_checksum string, event string"
    one = spark.createDataFrame([("d", "s/views/v", "object", "a", "f", "applied")], cols)
    sh.append_history(one, path)
    sh.append_history(one, path, after_id=sh.last_id(sh.read_history(spark, path)))
    log = sh.read_history(spark, path)
    assert log.count() == 2 and log.select("id").distinct().count() == 2
    assert log.first().git_hash is None
    broken = one.withColumn("live_definition_checksum", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="cannot capture"):
        sh.append_history(broken, path)
    assert sh.read_history(spark, path).count() == 2


def test_catalog_source(spark, tmp_path, rows):
    path = str(tmp_path / "cat")
    spark.createDataFrame([("d", "S", "USER_TABLE", "T1", None)],
                          "database_name string, schema_name string, type_desc string, "
                          "object_name string, parent_name string").write.parquet(path)
    assert rows(sc.read_catalog(spark, path), "normalized_key", "row_kind") == [("s/tables/t1", "object")]
    with pytest.raises(ValueError):
        sc.read_catalog(spark)
    with pytest.raises(ValueError):
        sc.read_catalog(spark, path, {"url": "x"})


def test_snapshot_publication(spark, tmp_path, rows):
    r = spark.createDataFrame([("d", "k", "s", "tables", "o", "", "g")], KEYS + (
        ", schema_name string, kind string, object_name string, parent_name string, layout_digest string"))
    from reconcile.operators.snapshot import snapshot_meta
    sc.write_snapshot(r, snapshot_meta(r), str(tmp_path / "snap"))
    got, meta = sc.read_snapshot(spark, str(tmp_path / "snap"))
    assert got.count() == 1 and meta.first().object_count == 1
    # a run that dies between rows and metadata leaves the earlier snapshot in force
    sc.write_snapshot_rows(r.limit(0), str(tmp_path / "snap"))
    assert rows(sc.read_snapshot(spark, str(tmp_path / "snap"))[0]) == rows(r)
    # rows that don't add up to the metadata's count are not valid
    short = sc.write_snapshot_rows(r.limit(0), str(tmp_path / "snap"))
    sc.write_snapshot_meta(snapshot_meta(r), str(tmp_path / "snap"), short)
    assert sc.read_snapshot(spark, str(tmp_path / "snap"))[1].isEmpty()


EVENTS = ("database_name string, event_type string, schema_name string, object_name string, "
          "version bigint, ts timestamp")


def test_watched_events(spark):
    names = ["CREATE_TABLE", "ALTER_INDEX", "DROP_TYPE", "ALTER_TYPE", "ALTER_SYNONYM", "GRANT_DATABASE",
             "CREATE_SCHEMA", None]
    df = spark.createDataFrame([(n,) for n in names], "e string")
    got = [r[0] for r in df.select(ch.watched_event(F.col("e"))).collect()]
    assert got == [True, True, True, False, False, False, False, False]


def test_stream_equals_batch_in_any_order(spark, tmp_path, rows):
    rng = random.Random(3)
    data = [("d", rng.choice(["ALTER_TABLE", "GRANT_X"]), rng.choice(["S", "Deploy_Meta", None]),
             rng.choice(["A", "b", None, "c"]), v, None) for v in range(300)]
    rng.shuffle(data)
    src = tmp_path / "events"
    for i in range(0, 300, 100):
        spark.createDataFrame(data[i:i + 100], EVENTS).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(src))
    state = str(tmp_path / "state")
    for _ in range(2):   # the second run replays nothing and must change nothing
        q = ch.upsert_query(ch.stream_object_ddl(stream), state, str(tmp_path / "cp"))
        q.awaitTermination()
    want = {}
    for _, e, s, o, v, _ in data:
        if e == "ALTER_TABLE" and s == "S" and o:
            want[o.lower()] = max(v, want.get(o.lower(), -1))
    got = ch.read_object_ddl(spark, state)
    assert dict(rows(got, "object_name", "ddl_version")) == want
    assert spark.read.parquet(state).select("batch_id").distinct().count() >= 3
    base = str(tmp_path / "compacted")
    last = ch.compact_object_ddl(spark, state, base)
    assert last >= 2
    again = ch.read_object_ddl(spark, state, base, last)
    assert dict(rows(again, "object_name", "ddl_version")) == want


def test_history_tail_stream(spark, tmp_path, rows):
    cols = ("id bigint, " + KEYS + ", kind string, checksum string, live_definition_checksum string, "
            "applied_ddl_version bigint, event string")
    data = [(i, "d", f"k{i % 4}", "object", f"c{i}", None, i, "applied" if i % 3 else "failed")
            for i in range(60)]
    random.Random(1).shuffle(data)
    src = tmp_path / "log"
    for i in range(0, 60, 20):
        spark.createDataFrame(data[i:i + 20], cols).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(src))
    state = str(tmp_path / "state")
    ch.upsert_query(tail.stream_latest_history(stream), state, str(tmp_path / "cp")).awaitTermination()
    batch = hs.latest_object_history(spark.createDataFrame(data, cols))
    assert rows(tail.read_latest_history(spark, state), "normalized_key", "id", "checksum") == rows(
        batch, "normalized_key", "id", "checksum")


def test_damaged_snapshots_fail(spark, tmp_path):
    from reconcile.sources import snapshots

    (tmp_path / "bad" / "objects").mkdir(parents=True)
    (tmp_path / "bad" / "objects" / "a.json").write_text('{"snapshot_key": "a"')
    (tmp_path / "short" / "objects").mkdir(parents=True)
    (tmp_path / "short" / "objects" / "a.json").write_text('{"snapshot_key": "a", "object_path": "p"}\n')
    for name in ("bad", "short"):
        with pytest.raises(Exception):
            snapshots.read_snapshots(spark, str(tmp_path / name), "lines").collect()


def test_gate_fails_on_nulls(spark):
    from reconcile.operators import gate

    ddl = "snapshot_key string, object_path string, planned_action string, checksum_hex string, exists boolean"
    base = spark.createDataFrame([("k", "p", "skip_unchanged", "aa", True)], ddl)
    cur = spark.createDataFrame([("k", None, None, None, None)], ddl)
    delta = spark.createDataFrame([("k",)], "snapshot_key string")
    assert [r.category for r in gate.compare_snapshots(base, cur, delta).collect()] == ["risky"]
    assert gate.snapshot_parity(base, cur).count() == 4
    assert gate.compare_snapshots(base, base, delta).count() == 0


def test_blocked_baseline_is_refused_without_adoptions(spark):
    from reconcile.operators import products

    ddl = "database_name string, normalized_key string, checksum string, planned_action string, blocked boolean"
    plan = spark.createDataFrame([("d", "k", "aa", "fail", True)], ddl)
    with pytest.raises(Exception, match="refused"):
        products.metadata_records(plan).collect()
    assert products.metadata_records(plan, "repair").count() == 1
