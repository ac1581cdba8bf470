"""Column functions against small pure-Python oracles."""

import hashlib
import re
import struct

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from reconcile.functions import checksums as ck, kinds, paths, text as tx
from reconcile.operators import scope as sp, telemetry as tm

C = F.col
CONFIG = settings(max_examples=5, deadline=None,
                  suppress_health_check=[HealthCheck.function_scoped_fixture])


def apply(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expr(C("v")).alias("out")).orderBy("i").collect()]


def test_normalize_and_candidates(spark):
    got = apply(spark, ["sql/a/b.sql", " db\\s\\t.sql ", "  ", "repo/sql/x", "sql/sql/y"],
                lambda c: paths.normalize_path(c, "repo/sql/"))
    assert got == ["a/b.sql", "db/s/t.sql", None, "x", "sql/y"]
    got = apply(spark, ["s/t.sql", "db/s/t.sql", "/s/t.sql"],
                lambda c: paths.path_candidates(F.lit("db"), c))
    assert got == [["s/t.sql", "db/s/t.sql"], ["db/s/t.sql", "s/t.sql"], ["/s/t.sql", "db/s/t.sql"]]


def test_key_from_path(spark):
    got = apply(spark, ["db/Dbo/Tables/T1.sql", "dbo/tables/t.sql", "a/b/c/D/x.sql.sql", "x"],
                paths.key_from_path)
    assert got == ["dbo/tables/t1", None, "c/d/x", None]


NAMES = ["001_abcdef0_step.sql", "001_ABCDEF01_a_b.SQL", "01_abcdef0_x.sql", "001_abcdef_x.sql",
         "001_abcdef0_.sql", "001_abcdefg_x.sql", "0011_abcdef0_x.sql", "001_abcdef0_x.txt",
         "001_abcdef0.sql", "_abcdef0_x.sql"]


def transition_oracle(path):
    p = path.split("/")
    if len(p) < 6 or p[-4] != "tables" or p[-3] != "_migrations":
        return None
    m = re.fullmatch(r"([0-9]{3})_([0-9a-fA-F]{7,})_(.+)\.[sS][qQ][lL]", p[-1], re.S)
    return (f"{p[-5]}/tables/{p[-2]}".lower(), m[1]) if m else None


@CONFIG
@given(st.lists(st.tuples(
    st.sampled_from(["db/S", "S", "a/db/S", ""]), st.sampled_from(["tables", "Tables", "views"]),
    st.sampled_from(["_migrations", "migrations"]), st.sampled_from(["T1", "x y", "ü"]),
    st.one_of(st.sampled_from(NAMES), st.from_regex(r"\A[0-9]{2,4}_[0-9a-g]{6,8}_[a-z]?\.sql\Z")),
), min_size=1, max_size=60))
def test_parse_transition(spark, parts):
    values = ["/".join(p) for p in parts]
    got = apply(spark, values, paths.parse_transition)
    assert [(r.normalized_key, r.ordinal) if r else None for r in got] == [
        transition_oracle(v) for v in values]


@CONFIG
@given(st.lists(st.text(alphabet="a\r\nü;", max_size=12), min_size=1, max_size=80))
def test_content_checksum(spark, values):
    want = [hashlib.sha256(v.replace("\r\n", "\n").encode()).hexdigest() for v in values]
    assert apply(spark, values, ck.content_checksum) == want


@CONFIG
@given(st.lists(st.lists(st.sampled_from([b"\r", b"\n", b"\x80", b"\xff", b"a"])).map(b"".join),
                min_size=1, max_size=60))
def test_content_checksum_bytes(spark, values):
    want = [hashlib.sha256(v.replace(b"\r\n", b"\n")).hexdigest() for v in values]
    assert apply(spark, [bytearray(v) for v in values], ck.content_checksum_bytes, "binary") == want


def flat_digest(names):
    h = hashlib.sha256()
    for n in sorted(set(names), key=lambda s: s.encode()):
        h.update(struct.pack("<Q", len(n.encode())) + n.encode())
    return h.hexdigest()


def tree_digest(names, fan_out):
    tree = {}
    for n in set(names):
        spread = int(hashlib.sha256(n.encode()).hexdigest()[:12], 16)
        tree.setdefault(spread % fan_out, {}).setdefault(spread // fan_out % fan_out, []).append(n)
    join = lambda ds: hashlib.sha256("\n".join(ds).encode()).hexdigest()
    return join(join(flat_digest(leaves[k]) for k in sorted(leaves)) for _, leaves in sorted(tree.items()))


@CONFIG
@given(st.lists(st.text(alphabet="ab/ü\U0001f600", max_size=6), min_size=1, max_size=60))
def test_layout_digest(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "path string")
    for fan_out in (1, 7):
        got = sp.layout_digest(df, fan_out).first()
        assert (got.layout_digest, got.scripts) == (tree_digest(names, fan_out), len(set(names)))


def test_layout_digest_separates_paths(spark):
    one = spark.createDataFrame([("a",), ("bc",)], "path string")
    two = spark.createDataFrame([("ab",), ("c",)], "path string")
    assert sp.layout_digest(one).first() != sp.layout_digest(two).first()
    empty = spark.createDataFrame([], "path string")
    assert sp.layout_digest(empty, 1).first().layout_digest == hashlib.sha256(b"").hexdigest()


@CONFIG
@given(st.lists(st.text(alphabet="abc/ü", min_size=1, max_size=8), unique=True, min_size=1,
                max_size=60), st.integers(0, 9))
def test_spot_check(spark, keys, n):
    def rank(k):
        h = hashlib.sha256(b"digest\0" + k.encode()).digest()
        return int.from_bytes(h[:8], "little")

    df = spark.createDataFrame([(db, k) for k in keys for db in ("d1", "d2")],
                               "database_name string, normalized_key string")
    got = sorted((r[0], r[1]) for r in sp.spot_check(df, "digest", n).collect())
    best = sorted(keys, key=rank)[:n]
    assert got == sorted((db, k) for k in best for db in ("d1", "d2"))


@CONFIG
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.booleans()), min_size=1,
                max_size=120))
def test_latency_summary(spark, data):
    df = spark.createDataFrame(data, "mode int, wall_ms bigint, failed boolean")
    for r in tm.latency_summary(df, ["mode"]).collect():
        walls = sorted(w for m, w, _ in data if m == r.mode)
        at = lambda q: walls[min(len(walls) - 1, int(q * len(walls)))]
        assert (r.n, r.p50, r.p95, r.max) == (len(walls), at(0.5), at(0.95), walls[-1])
        assert r.failures == sum(f for m, _, f in data if m == r.mode)


def test_decode_checksum(spark):
    a = "AB" * 32
    got = apply(spark, ["", "  ", a, f" {a} ", "xyz", a[:-1], None], ck.decode_checksum)
    assert [(r.value, r.valid) for r in got] == [
        (ck.ZERO_DIGEST, True), (ck.ZERO_DIGEST, True), (a.lower(), True), (a.lower(), True),
        (None, False), (None, False), (None, False)]


@pytest.mark.parametrize("base,run,want", [
    (None, None, "n/a"), (5, 5, "="), (0, None, "="), (0, 7, "+7ms"), (None, 7, "+7ms"),
    (100, 150, "+50ms (+50%)"), (200, 199, "-1ms (-0%)"), (1000, 995, "-5ms (-0%)"),
    (8, 9, "+1ms (+12%)"), (8, 11, "+3ms (+38%)"),
])
def test_delta_text(spark, base, run, want):
    df = spark.createDataFrame([(base, run)], "b bigint, r bigint")
    assert df.select(tx.delta_ms_text(C("b"), C("r"))).first()[0] == want


def test_delta_label(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("", "b"), (None, None)], "b string, r string")
    got = [r[0] for r in df.select(tx.delta_label_text(C("b"), C("r"))).collect()]
    assert got == ["a -> b", "=", "n/a -> b", "n/a"]


def test_scaffold_identity(spark):
    got = apply(spark, ["x/001_abc123_auto_add.sql", "001_xyz_a.sql", "001_" + "a" * 41 + "_b.sql",
                        "plain.sql"], tx.scaffold_identity)
    assert got == ["001_REV_auto_add.sql", "001_xyz_a.sql", "001_" + "a" * 41 + "_b.sql", "plain.sql"]


def test_names(spark):
    values = ["a", "", ".", "..", "a/b", "a\\b", "a\0b", "x" * 129, "ok-1_2", "sp ace"]
    assert apply(spark, values, paths.valid_component) == [
        True, False, False, False, False, False, False, True, True, True]
    assert apply(spark, values, paths.valid_token) == [
        True, False, False, False, False, False, False, True, True, False]
    assert apply(spark, values, paths.valid_ident)[7] is False
    assert apply(spark, ["a]b"], paths.bracket_ident) == ["[a]]b]"]


def test_classify(spark):
    cases = {
        "db/s/tables/t.sql": "object", "db/checks/c.sql": "check", "db/s/checks/c.sql": "check",
        "db/checks/tables/t.sql": "object", "db/s/tables/_migrations/t/001_abcdef0_x.sql": "transition",
        "db/s/tables/_migrations/t/x.sql": "ignored", "db/s/widgets/t.sql": "ignored",
        "db/_migrations/tables/t.sql": "object", "db/s/old/tables/t.sql": "ignored", "t.sql": "ignored",
    }
    assert apply(spark, list(cases), paths.classify_path) == list(cases.values())


def test_utf16_units(spark):
    assert apply(spark, ["ab", "ü", "\U0001f600x"], paths.utf16_units) == [2, 1, 3]


def test_scaffold_marker(spark):
    m = paths.SCAFFOLD_MARK
    assert apply(spark, [m, m + "\r\nx", "x\n" + m, m + " more", ""], paths.is_scaffold) == [
        True, True, False, True, False]


def test_dates(spark):
    expr = lambda c: F.date_format(ck.parse_commit_date(c), "yyyy-MM-dd HH:mm:ss")
    got = apply(spark, ["2024-05-01T10:00:00+02:00", "", "nope", None], expr)
    assert got == ["2024-05-01 08:00:00"] + ["1900-01-01 00:00:00"] * 3


def test_kinds(spark):
    got = apply(spark, ["USER_TABLE", "Service_Queue", "Odd"], kinds.kind_from_type_desc)
    assert got == ["tables", "queues", "odd"]
