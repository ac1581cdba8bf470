"""Snapshots published by several runs, some overtaken, some stopped halfway."""

import pytest

from reconcile.plans import catalog_snapshots as cs
from reconcile.sources import catalog as sc
from reconcile.sources.versions import VersionLog

K = "database_name string, normalized_key string"
ROWS = f"{K}, schema_name string, kind string, object_name string"


def objects(dbs, n=3, tag=""):
    return [(d, f"s/views/o{i}{tag}", "s", "views", f"o{i}{tag}") for d in dbs for i in range(n)]


def tables(spark, rows):
    manifest = spark.createDataFrame([(*r, f"{r[0]}/{r[1]}.sql") for r in rows], f"{ROWS}, object_path string")
    return manifest, spark.createDataFrame([(*r, None) for r in rows], f"{ROWS}, parent_name string")


def names(df):
    return sorted((r.database_name, r.normalized_key) for r in df.collect())


def test_publish_and_reuse(spark, tmp_path):
    path = str(tmp_path / "snap")
    manifest, catalog = tables(spark, objects(["a", "b"]))
    assert names(cs.reuse(spark, path, manifest)) == []
    # b isn't covered, so only a is published
    assert cs.publish(catalog.filter("database_name = 'a' or object_name <> 'o1'"), manifest, path) == ["a"]
    assert names(cs.reuse(spark, path, manifest)) == [r[:2] for r in objects(["a"])]
    # b follows in a version of its own; a stays
    assert cs.publish(catalog.filter("database_name = 'b'"), manifest, path) == ["b"]
    assert names(cs.reuse(spark, path, manifest)) == [r[:2] for r in objects(["a", "b"])]
    # nothing covered: the version in force stays
    assert cs.publish(catalog.limit(0), manifest, path) == [] and VersionLog(spark, path).latest() == 1
    # another layout of equal size: exact reuse refuses, relaxed reuse takes the count
    moved, _ = tables(spark, objects(["a", "b"], tag="x"))
    assert names(cs.reuse(spark, path, moved)) == []
    assert len(names(cs.reuse(spark, path, moved, relaxed=True))) == 6
    grown, _ = tables(spark, objects(["a", "b"], 4))
    assert names(cs.reuse(spark, path, grown, relaxed=True)) == []


def test_two_publishers_at_once_and_one_that_stops(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    manifest, catalog = tables(spark, objects(["a", "b"]))
    take, tries = VersionLog.take, []

    def overtaken(self, version, content):
        """Just before the first publisher takes its number, another one takes it."""
        tries.append(version)
        if len(tries) == 1:
            assert cs.publish(catalog.filter("database_name = 'b'"), manifest, path) == ["b"]
        return take(self, version, content)

    monkeypatch.setattr(VersionLog, "take", overtaken)
    assert cs.publish(catalog.filter("database_name = 'a'"), manifest, path) == ["a"]
    assert tries == [0, 0, 1]
    monkeypatch.undo()
    # neither entry is lost
    assert names(cs.reuse(spark, path, manifest)) == [r[:2] for r in objects(["a", "b"])]

    # a publisher that stops after its rows leaves everything as it was
    sc.write_snapshot_rows(cs.published(spark, path)[0].limit(1), path)
    (tmp_path / "snap/versions/.draft-dead").write_text("{")
    assert VersionLog(spark, path).latest() == 1
    assert len(names(cs.reuse(spark, path, manifest))) == 6

    # rows that don't add up to their count aren't reused
    short = sc.write_snapshot_rows(cs.published(spark, path)[0].filter("object_name <> 'o0'"), path)
    log = VersionLog(spark, path)
    content = log.read(1)
    content["databases"]["a"]["folder"] = short
    assert log.take(2, content)
    assert names(cs.reuse(spark, path, manifest)) == [r[:2] for r in objects(["b"])]


def test_a_publisher_that_is_always_overtaken_gives_up(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "v"))

    def prepare(last):
        log.take(0 if last is None else last + 1, {})
        return {}

    with pytest.raises(RuntimeError, match="overtaken"):
        log.publish(prepare, attempts=3)
