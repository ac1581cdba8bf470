"""Operators against brute force on small data, with hot keys."""

import hashlib
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from reconcile.functions.checksums import ZERO_DIGEST
from reconcile.operators import (
    catalog as ct, evolution as ev, fingerprint as fp, gate, history as hs, provenance as pv,
    scope as sp, snapshot as sn, telemetry as tm, validate as vd,
)

KEYS = "database_name string, normalized_key string"
CONFIG = settings(max_examples=4, deadline=None,
                  suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_latest_history_with_a_hot_key(spark, rows):
    data = [(i, "d", "hot" if i % 3 else f"k{i}", "object", f"c{i}", None, i,
             "applied" if i % 5 else "failed") for i in range(3000)]
    df = spark.createDataFrame(
        data, "id bigint, " + KEYS + ", kind string, checksum string, "
        "live_definition_checksum string, applied_ddl_version bigint, event string")
    want = {}
    for i, _, k, _, c, *_ in data:
        if i % 5:
            want[k] = c
    got = dict(rows(hs.latest_object_history(df), "normalized_key", "checksum"))
    assert got == want
    keys = spark.createDataFrame([("d", "hot")], KEYS)
    assert hs.latest_object_history(df, keys).count() == 1


def test_hot_object_state_is_chunked(spark):
    n, chunk = 1000, 64
    child = spark.range(n).select(
        F.lit("d").alias("database_name"), F.lit("hot").alias("normalized_key"),
        F.col("id").alias("o"), (F.col("id") * 7).alias("v"), F.lit(None).cast("int").alias("w"))
    small = spark.createDataFrame([("d", "small", 2, 20, None), ("d", "small", 1, 10, None),
                                   ("d", "far", 900, 1, None)], child.schema)
    objects = spark.createDataFrame([("d", k, "tables", None) for k in ("hot", "small", "bare", "far")],
                                    KEYS + ", kind string, note string")
    kids = {"columns": (child.unionByName(small), "o", ["v", "w"])}
    got = {r.normalized_key: r for r in fp.canonical_state(objects, ["note"], kids, chunk).collect()}
    one = lambda n, text: {"rows": n, "chunks": [hashlib.sha256(text.encode()).hexdigest()]}
    assert json.loads(got["small"].state) == {
        "note": None, "columns": one(2, '[{"v":10,"w":null},{"v":20,"w":null}]')}
    chunks = fp.child_chunks(*kids["columns"], chunk).filter("normalized_key = 'small'").collect()
    assert [(r.chunk_no, r.n, r.json) for r in chunks] == [(0, 2, '[{"v":10,"w":null},{"v":20,"w":null}]')]
    assert got["bare"].state == '{"note":null,"columns":null}'
    assert json.loads(got["far"].state) == {"note": None, "columns": one(1, '[{"v":1,"w":null}]')}
    digests = []
    for lo in range(0, n, chunk):
        part = [{"v": i * 7, "w": None} for i in range(lo, min(lo + chunk, n))]
        digests.append(hashlib.sha256(json.dumps(part, separators=(",", ":")).encode()).hexdigest())
    state = json.loads(got["hot"].state)
    assert state["columns"] == {"rows": n, "chunks": digests}
    want = hashlib.sha256(("tables:" + got["hot"].state).encode()).hexdigest()
    assert got["hot"].live_checksum == want


def test_repeated_ordinals_fail(spark):
    child = spark.range(10).select(
        F.lit("d").alias("database_name"), F.lit("k").alias("normalized_key"),
        F.lit(1).alias("o"), "id")
    with pytest.raises(Exception, match="child ordinals are not unique"):
        fp.child_list(child, "c", "o", ["id"], chunk=4).collect()


def test_no_state_no_fingerprint(spark):
    df = spark.createDataFrame([("views", ""), ("views", None), ("views", "x")], "k string, s string")
    got = [r[0] for r in df.select(fp.fingerprint(F.col("k"), F.col("s"))).collect()]
    assert got == [None, None, hashlib.sha256(b"views:x").hexdigest()]


def changed_oracle(objects, steps, changed):
    known = {**{p: k for p, k in steps}, **{p: k for p, k in objects}}
    out = set()
    for raw in changed:
        p = raw.strip(" ").replace("\\", "/")
        if not p:
            continue
        if p in known:
            out.add((p.split("/")[0], known[p]))
            continue
        for path, k in [*objects, *steps]:
            if path.endswith(p) or p.endswith(path):
                out.add((path.split("/")[0], k))
    return out


PATHS = ["db/s/tables/t1.sql", "db/s/tables/t2.sql", "db2/s/tables/t1.sql", "db/s/views/at1.sql"]
STEPS = ["db/s/tables/_migrations/t1/001_abcdef0_x.sql", "db2/s/tables/_migrations/t1/001_abcdef0_x.sql"]


@CONFIG
@given(st.lists(st.one_of(
    st.sampled_from(PATHS + STEPS), st.sampled_from(PATHS + STEPS).map(lambda p: "x/" + p),
    st.sampled_from(PATHS + STEPS).flatmap(lambda p: st.integers(0, len(p)).map(lambda i: p[i:])),
    st.sampled_from([" ", "t1.sql", "nothing", "db\\s\\tables\\t2.sql", ".sql", "z.sql"]),
), max_size=8))
def test_changed_paths(spark, changed):
    objects = [(p, "/".join(p[:-4].split("/")[1:])) for p in PATHS]
    steps = [(p, "s/tables/t1") for p in STEPS]
    m = spark.createDataFrame(objects, "object_path string, normalized_key string")
    t = spark.createDataFrame(steps, "path string, normalized_key string")
    c = spark.createDataFrame([(x,) for x in changed], "path string")
    got = {(r[0], r[1]) for r in sp.keys_for_changed_paths(m, t, c).collect()}
    assert got == changed_oracle(objects, steps, changed)


def test_delta_closure(spark, rows):
    m = spark.createDataFrame(
        [("d", "s/triggers/tr", "s", "triggers"), ("d", "s/tables/t1", "s", "tables"),
         ("d", "s/views/v", "s", "views")], KEYS + ", schema_name string, kind string")
    c = spark.createDataFrame([("d", "s/triggers/tr", "triggers", "T1")],
                              KEYS + ", kind string, parent_name string")
    delta = spark.createDataFrame([("d", "s/triggers/tr")], KEYS)
    assert rows(sp.expand_delta(delta, m, c), "snapshot_key") == [
        ("d/s/tables/t1",), ("d/s/triggers/tr",)]
    none = c.limit(0)
    assert rows(sp.expand_delta(delta, m, none), "snapshot_key") == [("d/s/triggers/tr",)]


def test_inspect_scope(spark, rows):
    kinds = ["tables"] * 30 + ["views"]
    m = spark.createDataFrame([("d", f"k{i}", k, "a") for i, k in enumerate(kinds)],
                              KEYS + ", kind string, checksum string")
    latest = spark.createDataFrame(
        [("d", f"k{i}", "a" if i > 1 else ("b" if i else "")) for i in range(31)],
        KEYS + ", checksum string")
    delta = spark.createDataFrame([("d", "k2")], KEYS)
    scope = sp.inspect_scope(m, delta, latest, "digest")
    hot = {k for k, s in rows(scope, "normalized_key", "state") if s == "hot"}
    assert {"k0", "k1", "k2", "k30"} <= hot and len(hot) == 4 + 8
    v = sp.scope_verdict(scope).first()
    assert (v.hot, v.total, v.full_inspect, v.allow_cache) == (12, 31, False, False)
    full = sp.inspect_scope(m, delta, latest, "digest", n=40)
    assert sp.scope_verdict(full).first().full_inspect
    assert sp.scope_verdict(sp.inspect_scope(m, delta, latest, "x", full=True)).first().hot == 31


@pytest.mark.parametrize("given_rows,source,full,paths", [
    ([("env-full-inspect", None), ("git-head", "sql/a")], "env-full-inspect", True, []),
    ([("env-changed-files", "sql/a"), ("git-head", "b")], "env-changed-files", False, ["a"]),
    ([("env-git-base", None), ("git-head", "b")], "env-git-base", False, []),
    ([("env-git-base-failed", None), ("git-head", "b")], "env-git-base-failed", True, []),
    ([("ci-github-pr", None), ("git-head", "b")], "ci-github-pr", False, []),
    ([("git-merge-base", None), ("git-head", "b")], "git-head", False, ["b"]),
    ([("git-head", None), ("git-head-parent", "c")], "git-head-parent", False, ["c"]),
    ([("git-head", None)], "git-head", False, []),
])
def test_change_source(spark, rows, given_rows, source, full, paths):
    df = spark.createDataFrame(given_rows, "source string, path string")
    win = sp.choose_source(df).first()
    assert (win.source, win.full_inspect) == (source, full)
    assert [p for (p,) in rows(sp.choose_changed(df), "path")] == paths


def fill_oracle(lines):
    head, out = None, []
    for i, line in enumerate(lines):
        t = line.strip(" ")
        if not t:
            continue
        if t.startswith("COMMIT\x1f") and t.split("\x1f")[1]:
            head = t.split("\x1f")[1]
        elif head:
            out.append((i, t, head))
    return out


@CONFIG
@given(st.lists(st.sampled_from(["a.sql", "b.sql", "", " c.sql "] + [
    f"COMMIT\x1fh{i}\x1fann\x1f2024" for i in range(4)]), max_size=60), st.integers(1, 9))
def test_commit_carry_crosses_blocks(spark, lines, block):
    df = spark.createDataFrame([("f", i // block, i, ln) for i, ln in enumerate(lines)],
                               "file string, block bigint, line_no bigint, line string")
    got = sorted((r.line_no, r.path, r.git_hash) for r in pv.attach_commit(df).collect())
    assert got == fill_oracle(lines)


@CONFIG
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.sampled_from([None, 1, 2])),
                unique_by=lambda t: t[:2], max_size=60), st.integers(1, 9))
def test_previous_crosses_blocks(spark, data, block):
    from reconcile.operators.ordered import previous

    df = spark.createDataFrame([(g, o // block, o, v) for g, o, v in data],
                               "g int, b bigint, o int, v int")
    got = {(r.g, r.o): r.p for r in previous(df, ["g"], "b", "o", "v", "p").collect()}
    want, last = {}, {}
    for g, o, v in sorted(data, key=lambda t: t[:2]):
        want[(g, o)] = last.get(g)
        last[g] = v
    assert got == want


def test_layout_prefix_and_latest(spark, rows):
    df = spark.createDataFrame(
        [(1, "sql/a", "h1", "x", "d"), (2, "sql/a", "h0", "y", "d"), (3, "b", "h0", "y", "d")],
        "line_no int, path string, git_hash string, git_author string, git_date string")
    latest = pv.latest_commit_per_path(pv.layout_paths(df, "sql/"), ["line_no"])
    assert rows(latest, "object_path", "git_hash") == [("a", "h1"), ("b", "h0")]


SCRIPT = """-- header (not, a, column)
CREATE TABLE [dbo].[T] (
    [Id] INT IDENTITY(1,1) NOT NULL, -- the, key
    Name NVARCHAR(50) NULL,
    amount DECIMAL(10, 2) NOT NULL DEFAULT (0),
    kind CHAR(1) CHECK (kind IN ('a','b')),
    total AS (amount * 2),
    CONSTRAINT pk PRIMARY KEY (Id),
    PRIMARY KEY (Id)
) ON [PRIMARY]
"""


def columns_of(spark, *scripts):
    df = spark.createDataFrame(
        [("d", f"k{i}", "tables", t) for i, t in enumerate(scripts)],
        KEYS + ", kind string, content string")
    out = [[] for _ in scripts]
    for r in ev.script_columns(df).orderBy("normalized_key", "ordinal").collect():
        out[int(r.normalized_key[1:])].append((r.column_name, r.type_name, r.nullable))
    return out


def test_columns_of_scripts(spark):
    none = columns_of(spark, "SELECT 1", "", None, "CREATE TABLE t (a INT, b (INT", "CREATE TABLE t ()")
    assert none == [[]] * 5
    cols = [("id", "INT IDENTITY(1,1)", False), ("name", "NVARCHAR(50)", True),
            ("amount", "DECIMAL(10, 2)", False), ("kind", "CHAR(1) CHECK (KIND IN ('A','B'))", True)]
    assert columns_of(spark, SCRIPT, SCRIPT.replace("\n", "\r\n")) == [cols, cols]


def test_bracket_rule(spark):
    got = columns_of(spark, "CREATE TABLE t (plain [NVARCHAR](50) NULL, [two words] INT, "
                            "[sum] AS (a + b), total  AS  f(a, (b)), asof DATE)")
    assert got == [[("plain [nvarchar", "(50)", True), ("two words", "INT", True), ("asof", "DATE", True)]]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.recursive(st.just("1"), lambda t: st.lists(t, min_size=1, max_size=3).map(
    lambda x: "(" + ", ".join(x) + ")"), max_leaves=6), st.booleans()), min_size=1, max_size=8))
def test_nested_parentheses(spark, cols):
    body = ", -- x, (y\n".join(f"c{i} T{t} {'NULL' if n else 'NOT NULL'}" for i, (t, n) in enumerate(cols))
    want = [(f"c{i}", f"T{t}", n) for i, (t, n) in enumerate(cols)]
    assert columns_of(spark, f"CREATE TABLE t ({body}\n)") == [want]


def test_wide_table(spark):
    n = 31000
    [got] = columns_of(spark, "CREATE TABLE t (" + ",".join(f"c{i} INT" for i in range(n)) + ")")
    assert got == [(f"c{i}", "INT", True) for i in range(n)]


def test_additive_rules(spark, rows):
    cols = KEYS + ", ordinal int, column_name string, type_name string, nullable boolean"
    f = [("d", "s/tables/ok", 0, "a", "INT", True), ("d", "s/tables/ok", 1, "b]", "INT", False),
         ("d", "s/tables/drop", 0, "n", "INT", True), ("d", "s/tables/bad", 0, "n", "X;Y", True),
         ("d", "s/tables/same", 0, "a", "INT", True)]
    db = [("d", "s/tables/drop", None, "gone", "int", True), ("d", "s/tables/same", None, "a", "int", True)]
    diff = ev.column_diff(spark.createDataFrame(f, cols), spark.createDataFrame(db, cols))
    add = ev.additive_changes(diff)
    assert rows(add, "normalized_key", "additive") == [
        ("s/tables/bad", False), ("s/tables/drop", False), ("s/tables/ok", True)]
    text = ev.proposal_text(ev.proposed_changes(diff, add)).first().content
    assert text == (
        "-- Auto-generated migration for [s].[ok]\n-- Added columns: 2\n"
        "-- Review this migration before running.\n\n"
        "ALTER TABLE [s].[ok] ADD [a] INT NULL;\nALTER TABLE [s].[ok] ADD [b]]] INT NOT NULL;\n")


def test_template_without_columns(spark):
    one = spark.createDataFrame([("d", "s/tables/t")], KEYS)
    none = ct.column_lists(spark.createDataFrame(
        [], KEYS + ", column_name string, type_name string, nullable boolean"))
    text = ev.change_templates(one, none, "-- mark").first().content
    assert text == (
        "-- mark\n-- Table: [s].[t]\n-- Replace this scaffold with the actual migration SQL.\n"
        "-- Schema: s\n-- Table: t\n-- Press Ctrl+C to stop migration.\n")


def test_ownership(spark, rows):
    m = spark.createDataFrame([("d", "m"), ("d", "both")], KEYS)
    c = spark.createDataFrame([("d", "both"), ("d", "left"), ("d", "stray")], KEYS)
    h = spark.createDataFrame([("d", "left"), ("d", "left"), ("d", "old")], KEYS)
    got = rows(ct.ownership(m, c, h))
    assert got == [("d", "both", "managed", True, "none"), ("d", "left", "orphaned", True, "none"),
                   ("d", "m", "managed", False, "none"), ("d", "stray", "unmanaged", True, "none")]


def test_merge_stable_and_parents(spark, rows):
    a = spark.createDataFrame([("d", "x", 1)], KEYS + ", v int")
    b = spark.createDataFrame([("d", "x", 2), ("d", "y", 2)], KEYS + ", v int")
    assert rows(ct.merge_stable(a, b), "normalized_key", "v") == [("x", 1), ("y", 2)]
    t = spark.createDataFrame([("d", "s/triggers/a", "s", "x", "T1"), ("d", "s/triggers/b", "s", "y", None)],
                              KEYS + ", schema_name string, object_name string, parent_name string")
    tables = spark.createDataFrame([("d", "s/tables/t1", "tables", "t1", True, "c")],
                                   KEYS + ", kind string, object_name string, exists boolean, prior string")
    got = rows(ct.with_parent(t, tables), "normalized_key", "parent_managed", "parent_label")
    assert got == [("s/triggers/a", True, "t1"), ("s/triggers/b", False, None)]


def test_union_prunes_branches(spark):
    df = spark.createDataFrame([("d", "s", "k", "o")], ",".join(
        f"{c} string" for c in ("database_name", "schema_name", "kind", "object_name")))
    parts = {"objects": df, "types": df, "indexes": df}
    assert ct.union_catalog(parts, ["types"]).count() == 1
    assert ct.union_catalog(parts, ["tables", "indexes"]).count() == 2
    with pytest.raises(ValueError):
        ct.union_catalog(parts, [])
    assert ct.provable_empty(["tables"]) and not ct.provable_empty(["tables", "indexes"])


def test_history_guards(spark):
    cols = KEYS + ", kind string, checksum string, live_definition_checksum string, event string"
    ok = [("d", "s/queues/q", "object", "c", None, "applied"), ("d", "p", "migration", "c", None, "applied"),
          ("d", "s/views/v", "object", "c", None, "failed")]
    bad = [("d", "s/views/v", "object", "c", None, "adopted")]
    log = spark.createDataFrame(ok, cols)
    assert hs.append_history(log, spark.createDataFrame(ok, cols)).count() == 6
    broken = spark.createDataFrame(bad, cols)
    assert hs.missing_fingerprints(broken).count() == 1
    with pytest.raises(Exception, match="cannot capture live state checksum"):
        hs.append_history(log, broken).collect()
    junk = spark.createDataFrame([("d", "k", "zz")], KEYS + ", checksum string")
    assert hs.invalid_checksums(junk).count() == 1
    assert hs.decoded_checksums(junk, repair=True).first().checksum == ZERO_DIGEST
    with pytest.raises(Exception, match="undecodable"):
        hs.decoded_checksums(junk).collect()


def test_snapshot_reuse(spark, rows):
    keys = [("d1", f"k{i}") for i in range(3)] + [("d2", "k0")]
    cols = KEYS + ", schema_name string, kind string, object_name string, parent_name string"
    m = spark.createDataFrame(keys, KEYS)
    c = spark.createDataFrame([(*k, "s", "tables", "o", None) for k in keys[1:]], cols)
    snap = sn.snapshot_rows(c, m, "dig")
    assert rows(sn.snapshot_coverage(snap, m), "database_name", "publish") == [("d1", False), ("d2", True)]
    assert rows(sn.publishable_rows(snap, m), "database_name") == [("d2",)]
    meta = sn.snapshot_meta(sn.publishable_rows(snap, m))
    assert rows(sn.snapshot_valid(meta, m, "dig")) == [("d1", False), ("d2", True)]
    assert rows(sn.snapshot_valid(meta, m, "other")) == [("d1", False), ("d2", False)]
    assert rows(sn.snapshot_valid(meta, m, "other", relaxed=True)) == [("d1", False), ("d2", True)]


def test_report_comparison(spark, rows):
    cols = ("scenario string, exit_code int, blocked boolean, blockers array<string>, "
            "scaffold_paths array<string>")
    b = spark.createDataFrame([("a", 10, True, ["x"], ["p/001_abc_z.sql", "b.sql"]),
                               ("gone", 0, False, [], [])], cols)
    c = spark.createDataFrame([("a", 0, True, [], ["b.sql", "/abs/001_fff_z.sql"])], cols)
    assert rows(gate.compare_reports(b, c, "blocked"), "message") == [
        ('blockers: baseline=["x"] actual=[]',), ("exit_code: baseline=10 actual=0",),
        ("missing in actual",)]


def test_plan_report_comparison(spark, rows):
    cols = ("scenario string, setup_steps array<string>, io struct<query_calls:bigint>, "
            "timings struct<l1_cache_hit:boolean,plan_db_path:string>, action_counts map<string,int>")
    b = spark.createDataFrame([("a", [], (3,), (True, "cold_full"), {"x": 1, "y": 2})], cols)
    c = spark.createDataFrame([("a", [], (4,), (False, "incremental"), {"y": 2, "x": 2})], cols)
    assert rows(gate.compare_reports(b, c, "plan"), "message") == [
        ("action_counts: baseline=x=1,y=2 actual=x=2,y=2",), ("io.query_calls: baseline=3 actual=4",),
        ("timings.l1_cache_hit: baseline=true actual=false",),
        ("timings.plan_db_path: baseline=cold_full actual=incremental",)]


def test_profile_brute_force(spark, rows):
    rng = random.Random(7)
    names = ["0xa: bench_loop (m.rs:1)", "bench_warm", "HashMap x", "insert", "own::f", "own::main",
             "compute_diff", "String clone", "leaf"]
    frames = spark.createDataFrame(list(enumerate(names)), "frame_id int, frame string")
    data = [(i, rng.randrange(1, 99), [rng.randrange(10) for _ in range(rng.randrange(0, 5))])
            for i in range(80)]
    points = spark.createDataFrame(data, "point_id int, bytes bigint, frames array<int>")
    name = lambda f: names[f] if f < len(names) else f"<frame {f}>"
    phases, leaf, inclusive = {}, {}, {}
    for _, size, fs in data:
        joined = " ".join(name(f) for f in fs)
        ph = ("loop" if "bench_loop" in joined else "warm" if "bench_warm" in joined else
              "warm" if "compute_diff" in joined else "setup")
        phases[ph] = phases.get(ph, 0) + size
        if fs:
            short = name(fs[-1]).replace("0xa: ", "")
            leaf[short] = leaf.get(short, 0) + size
        for f in fs:
            if "own::" in name(f) and "main" not in name(f):
                inclusive[name(f)] = inclusive.get(name(f), 0) + size
    got = {}
    for ph, size in rows(tm.profile_rollup(points, frames, 20), "phase", "bytes"):
        got[ph] = got.get(ph, 0) + size
    assert got == phases
    totals = tm.frame_totals(points, frames, ["own::"], "main")
    assert dict(rows(totals.filter("view = 'leaf'"), "frame", "bytes")) == leaf
    assert dict(rows(totals.filter("view = 'inclusive'"), "frame", "bytes")) == inclusive
    top = tm.top_frames(totals.filter("view = 'leaf'"), 3).collect()
    assert [r.bytes for r in top] == sorted(leaf.values(), reverse=True)[:3]


def test_merge_timings(spark):
    cols = "seq int, " + ", ".join(f"{c} bigint" for c in tm.MERGE_MAX + tm.MERGE_SUM) + \
        ", l1_cache_hit boolean, plan_db_path string"
    one = (1, *range(1, 10), True, "cold_full")
    two = (2, *range(2, 11), False, "")
    r = tm.merge_timings(spark.createDataFrame([one, two], cols)).first()
    assert (r.connect_ms, r.parallel_wall_ms, r.ensure_ms) == (2, 3, 7)
    assert r.l1_cache_hit is False and r.plan_db_path == "cold_full"


def test_changed_since_scan(spark, rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    m = spark.createDataFrame([("d", "a", "pa", sha("x")), ("d", "b", "pb", sha("x\n")), ("d", "c", "pc", "")],
                              KEYS + ", object_path string, checksum string")
    now = spark.createDataFrame([("pa", "y"), ("pb", "x\r\n")], "object_path string, content string")
    assert rows(vd.changed_since_scan(m, now), "message") == [
        ("a: file changed after scan",), ("c: script not found",)]


def test_markers_beyond_one_mask(spark, rows):
    from reconcile.operators import telemetry as tl

    frames = spark.createDataFrame([(i, f"<m{i}>") for i in range(150)], "frame_id long, frame string")
    points = spark.createDataFrame([(i, 10 + i, [i]) for i in range(150)] + [(150, 1, []), (151, 2, None)],
                                   "point_id long, bytes long, frames array<long>")
    phases = [(f"p{i}", (f"<m{i}>",)) for i in range(150)]
    other = [tl.Category("other", ())]
    got = tl.classify_points(points, frames, phases, other, other)
    assert set(rows(got, "point_id", "bytes", "phase")) == set(
        [(i, 10 + i, f"p{i}") for i in range(150)] + [(150, 1, "setup"), (151, 2, "setup")])
