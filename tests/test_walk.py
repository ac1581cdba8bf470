"""The walk of a script tree against the operating system's own."""

import os
import random

import pytest

from reconcile.operators import validate as vd
from reconcile.sources import tree, walk


def test_walk_sees_hidden_names_and_no_links(spark, tmp_path, rows):
    rng = random.Random(1)
    root = tmp_path / "a b %41+é"  # characters that a URI would escape
    names = ["s", "_s", ".s", "T x", "ü"]
    want = {}
    for i in range(150):
        parts = [rng.choice(names) for _ in range(rng.randrange(0, 6))]
        name = rng.choice(["", ".", "_"]) + f"f{i}" + rng.choice([".sql", ".SQL", ".Sql", ".txt", ""])
        path = "/".join([*parts, name])
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(os.urandom(rng.randrange(50)))
        if name.lower().endswith(".sql"):
            want[path] = target.read_bytes()
    (root / "empty" / "deeper").mkdir(parents=True)
    os.symlink(root / "s", root / "link")
    os.symlink(root / next(iter(want)), root / "link.sql")
    for at in (str(root), f"{root}/"):
        found = walk.walk_tree(spark, at)
        assert {r.path: r.length for r in found.collect()} == {p: len(c) for p, c in want.items()}
    assert {r.path: bytes(r.content) for r in walk.read_scripts(found, str(root)).collect()} == want


def test_walk_refuses_names_that_are_not_text(spark, tmp_path):
    with open(os.fsencode(str(tmp_path)) + b"/\xff.sql", "wb") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="surrogates not allowed|codec can't"):
        walk.walk_tree(spark, str(tmp_path)).collect()


def test_empty_tree(spark, tmp_path):
    found = walk.walk_tree(spark, f"file://{tmp_path}")
    assert found.collect() == [] and walk.read_scripts(found, str(tmp_path)).columns == ["path", "length", "content"]


def test_walked_files_feed_the_layout_rules(spark, tmp_path, rows):
    """A hidden file in a place for objects is now refused by the layout rules."""
    scripts = [("db/s/views/v.sql", "CREATE VIEW v"), ("db/s/views/.v.sql", "x"), ("db/.git/old/x.sql", "x"), ("db/s/tables/_migrations/t/001_abcdef0_a.sql", "ALTER")]
    walk.write_scripts(spark.createDataFrame(scripts, "path string, content string"), str(tmp_path))
    walk.write_scripts(spark.createDataFrame(scripts, "path string, content string"), str(tmp_path))
    files = walk.read_scripts(walk.walk_tree(spark, str(tmp_path)), str(tmp_path))
    assert rows(files, "path") == sorted((p,) for p, _ in scripts)
    assert rows(tree.manifest_of(files), "normalized_key")[-1] == ("s/views/v",)
    assert "db/.git/old/x.sql" in {r.path for r in vd.layout_violations(files).collect()}


def test_contents_larger_than_a_batch(spark, tmp_path):
    sizes = [walk.BATCH_BYTES + 5, 0, 10, walk.BATCH_BYTES // 2, walk.BATCH_BYTES // 2 + 1, 7]
    for i, n in enumerate(sizes):
        (tmp_path / f"{i}.sql").write_bytes(b"x" * n)
    files = walk.read_scripts(walk.walk_tree(spark, str(tmp_path)).coalesce(1), str(tmp_path))
    assert sorted((r.path, r.length, len(r.content)) for r in files.collect()) == [(f"{i}.sql", n, n) for i, n in enumerate(sizes)]
