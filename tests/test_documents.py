"""JSON documents of any size: assembled by many tasks, read back by lines and as a whole."""

import json

import pytest
from pyspark.sql import functions as F

from reconcile.sources import plan_json as pj, snapshots as ss

PLAN = (
    "database_name string, normalized_key string, object_path string, schema_name string, kind string, object_name string, "
    "parent_name string, checksum string, planned_action string, exists boolean, blocked boolean, counter string, "
    "message string, transition_paths array<string>"
)
SCHEMAS = "database_name string, schema_name string, action string"
ODD = 'quote " comma, back\\slash\nnew line } ]'


@pytest.fixture(autouse=True)
def many_tasks(spark):
    """Small ranges stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def whole(folder):
    """What a tool sees that concatenates the files of a document."""
    return json.loads("".join(p.read_text() for p in sorted(folder.glob("*.txt"))))


def plan_of(spark, n, blocked=True):
    rows = []
    for db, size in (("big", n), ("1", 2), ("a=b/c", 1)):
        for i in range(size):
            bad = blocked and i % 3 == 1
            rows.append((db, f"s/views/v{i:06d}", f"p{i}", "s", "views", f"v{i}", ODD if i % 2 else None, f"{i:064x}",
                         "fail" if bad else "create_object", i % 2 == 0, bad, "changed" if bad else "create",
                         f"no way {i} {ODD}" if bad else None, ["a", "b"] if i % 5 == 0 else []))
    return spark.createDataFrame(rows, PLAN).repartition(7)


@pytest.mark.parametrize("blocked", [True, False])
def test_plan_documents_by_many_tasks(spark, tmp_path, rows, blocked):
    plan = plan_of(spark, 500, blocked)
    schemas = spark.createDataFrame([("big", f"s{i}", "exists") for i in range(5)] + [("1", "s", "create_schema")], SCHEMAS)
    pj.write_plan_documents(plan, schemas, str(tmp_path / "doc"), "plan", "now")
    big = tmp_path / "doc" / "doc=big"
    assert len(list(big.glob("*.txt"))) > 1
    doc = whole(big)
    assert [o["normalizedKey"] for o in doc["objects"]] == [f"s/views/v{i:06d}" for i in range(500)]
    assert doc["blocked"] == blocked and doc["command"] == "plan" and doc["plannedAt"] == "now"
    assert doc.get("blockers") == ([f"no way {i} {ODD}" for i in range(500) if i % 3 == 1] if blocked else None)
    assert doc["schemas"] == [{"action": "exists", "schemaName": f"s{i}"} for i in range(5)]
    n = len(doc.get("blockers") or [])
    assert doc["summary"] == {"schemaCount": 5, "objectCount": 500, "createCount": 500 - n, "adoptCount": 0, "skipCount": 0, "changedCount": n, "blockedCount": n}
    assert doc["objects"][1]["parentName"] == ODD and doc["objects"][5]["transitionPaths"] == ["a", "b"]
    assert whole(tmp_path / "doc" / "doc=1")["summary"]["schemaCount"] == 1
    got = pj.read_plans(spark, str(tmp_path / "doc"), "parts")
    cols = ["database_name", "normalized_key", "object_path", "checksum", "planned_action", "exists"]
    assert rows(got, *cols) == rows(plan, *cols)
    assert {r.command for r in got.select("command").distinct().collect()} == {"plan"}
    # the same document in one file, as any other tool would write it
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=1))
    assert rows(pj.read_plans(spark, str(tmp_path / "one.json")), *cols) == rows(plan.filter("database_name = 'big'"), *cols)


def test_incomplete_plan_documents_fail(spark, tmp_path):
    schemas = spark.createDataFrame([], SCHEMAS)
    pj.write_plan_documents(plan_of(spark, 200), schemas, str(tmp_path / "doc"))
    assert whole(tmp_path / "doc" / "doc=big")["schemas"] == []
    files = sorted((tmp_path / "doc" / "doc=big").glob("*.txt"))
    text = files[len(files) // 2].read_text().splitlines()
    files[len(files) // 2].write_text("\n".join(text[1:]) + "\n")
    for crc in (tmp_path / "doc" / "doc=big").glob(".*.crc"):
        crc.write_bytes(b"")
        crc.unlink()
    with pytest.raises(ValueError, match="incomplete"):
        pj.read_plans(spark, str(tmp_path / "doc"), "parts")


def test_required_plan_fields(spark, tmp_path):
    good = {"normalizedKey": "s/views/v", "objectPath": "p", "schemaName": "s", "kind": "views", "objectName": "v",
            "checksum": "AAECAwQFBgcICQoLDA0ODxAREhMUFRYXGBkaGxwdHh8=", "plannedAction": "create_object", "exists": False}
    folder = tmp_path / "lines" / "objects"
    folder.mkdir(parents=True)
    for field in [f for f in good if f != "checksum"]:
        (folder / "a.json").write_text(json.dumps({k: v for k, v in good.items() if k != field}))
        with pytest.raises(Exception, match=f"plan object without {field}"):
            pj.read_plans(spark, str(tmp_path / "lines"), "lines").collect()
    (folder / "a.json").write_text(json.dumps(good | {"plannedAction": "explode"}))
    with pytest.raises(Exception, match="unknown action explode"):
        pj.read_plans(spark, str(tmp_path / "lines"), "lines").collect()
    (folder / "a.json").write_text(json.dumps(good))
    assert pj.read_plans(spark, str(tmp_path / "lines"), "lines").count() == 1


def test_lines_layout_has_summary_schemas_and_blockers(spark, tmp_path):
    schemas = spark.createDataFrame([("big", "s", "exists"), ("big", "t", "create_schema")], SCHEMAS)
    pj.write_plans(plan_of(spark, 30), str(tmp_path / "p"), "plan", "now", schemas)
    head = spark.read.json(str(tmp_path / "p/header")).first()
    assert (head.command, head.plannedAt, head.blocked, head.objectCount, head.blockedCount) == ("plan", "now", True, 33, 11)
    assert (head.summary.schemaCount, head.summary.createCount, head.summary.changedCount) == (2, 22, 11)
    assert spark.read.json(str(tmp_path / "p/blockers")).filter(F.col("message").startswith("no way")).count() == 11
    assert {(r.schemaName, r.action) for r in spark.read.json(str(tmp_path / "p/schemas")).collect()} == {("s", "exists"), ("t", "create_schema")}
    text = spark.read.text(str(tmp_path / "p/objects"))
    assert text.filter(F.get_json_object("value", "$.transitionPaths") == '["a","b"]').count() == 8


def test_snapshot_document_by_many_tasks(spark, tmp_path, rows):
    ddl = "snapshot_key string, object_path string, planned_action string, checksum_hex string, exists boolean"
    snap = spark.createDataFrame([(f"k{i:05d}" + (ODD if i % 7 == 0 else ""), f"p{i}", "skip_unchanged", "c" * 64, i % 2 == 0) for i in range(400)], ddl).repartition(5)
    ss.write_snapshot_document(snap, str(tmp_path / "doc"), blocked=True)
    folder = tmp_path / "doc" / "doc=snapshot"
    assert len(list(folder.glob("*.txt"))) > 1
    doc = whole(folder)
    assert len(doc["objects"]) == 400 and doc["blocked"] is True and doc["version"]
    got = ss.read_snapshots(spark, str(tmp_path / "doc"), "parts")
    assert rows(got.drop("version", "blocked")) == rows(snap)
    assert {(r.version, r.blocked) for r in got.select("version", "blocked").collect()} == {(doc["version"], True)}
    (tmp_path / "one.json").write_text(json.dumps(doc))
    assert rows(ss.read_snapshots(spark, str(tmp_path / "one.json")).drop("version", "blocked")) == rows(snap)
    ss.write_snapshot_document(snap.limit(0), str(tmp_path / "empty"))
    assert whole(tmp_path / "empty" / "doc=snapshot")["objects"] == {}
    assert ss.read_snapshots(spark, str(tmp_path / "empty"), "parts").collect() == []
