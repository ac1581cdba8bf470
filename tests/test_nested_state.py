"""Lists inside list entries, against a plain Python fold."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from reconcile.operators import fingerprint as fp

K = "database_name string, normalized_key string"


def digest_list(entries, chunk):
    """JSON value of (ordinal, text) entries, None without any."""
    if not entries:
        return "null"
    chunks = {}
    for o, text in sorted(entries):
        chunks.setdefault(o // chunk, []).append(text)
    ds = [hashlib.sha256(f"[{','.join(v)}]".encode()).hexdigest() for _, v in sorted(chunks.items())]
    return f'{{"rows":{len(entries)},"chunks":["' + '","'.join(ds) + '"]}'


def dumps(**kw):
    return json.dumps(kw, separators=(",", ":"))


def tables(seed):
    """Three levels; one index of one table holds a third of all inner rows."""
    rng = random.Random(seed)
    keys = [f"t{i}" for i in range(6)]
    idx = [(k, i) for k in keys[:-1] for i in rng.sample(range(40), rng.randrange(1, 12))] + [(keys[0], 40)]
    cols = [(k, i, c) for k, i in idx for c in rng.sample(range(30), rng.randrange(0, 6))]
    cols += [(keys[0], 40, c) for c in range(30, 30 + len(cols) // 2)]
    parts = [(k, i, c, p) for k, i, c in cols[::3] for p in range(rng.randrange(1, 4))]
    return keys, idx, cols, parts


@pytest.mark.parametrize("chunk", [1, 4, 4096])
def test_nested_lists_equal_a_plain_fold(spark, chunk):
    keys, idx, cols, parts = tables(chunk)
    parts_df = spark.createDataFrame([("db", k, i, c, p, f"p{p}") for k, i, c, p in parts], f"{K}, index_id int, column_id int, part_no int, what string")
    cols_df = spark.createDataFrame([("db", k, i, c, None if c % 2 else f"c{c}") for k, i, c in cols], f"{K}, index_id int, column_id int, name string").repartition(5)
    idx_df = spark.createDataFrame([("db", k, i, f"i{i}") for k, i in idx], f"{K}, index_id int, name string")
    objects = spark.createDataFrame([("db", k, "tables", None) for k in keys], f"{K}, kind string, note string")
    inner = fp.ChildList(cols_df, "column_id", ["name"], {"parts": (parts_df, "part_no", ["what"])})
    # an inner entry without fields of its own is its lists alone
    got = fp.canonical_state(objects, ["note"], {"indexes": (idx_df, "index_id", ["name"], {"columns": inner})}, chunk)

    def columns(k, i):
        return digest_list([
            (c, dumps(name=None if c % 2 else f"c{c}")[:-1] + ',"parts":'
             + digest_list([(p, dumps(what=f"p{p}")) for k2, i2, c2, p in parts if (k2, i2, c2) == (k, i, c)], chunk) + "}")
            for k1, i1, c in cols if (k1, i1) == (k, i)
        ], chunk)

    want = {
        k: '{"note":null,"indexes":'
        + digest_list([(i, dumps(name=f"i{i}")[:-1] + ',"columns":' + columns(k, i) + "}") for k1, i in idx if k1 == k], chunk)
        + "}"
        for k in keys
    }
    rows = got.collect()
    assert {r.normalized_key: r.state for r in rows} == want
    assert all(r.live_checksum == hashlib.sha256(f"tables:{r.state}".encode()).hexdigest() for r in rows)
    assert want["t5"] == '{"note":null,"indexes":null}'


def test_a_change_deep_inside_moves_only_its_object(spark):
    def prints(extra):
        outer = spark.createDataFrame([("db", k, 0) for k in "ab"], f"{K}, o int")
        inner = spark.createDataFrame([("db", k, 0, i, i) for k in "ab" for i in range(9)] + extra, f"{K}, o int, p int, v int")
        objects = spark.createDataFrame([("db", k, "tables", "x") for k in "ab"], f"{K}, kind string, note string")
        out = fp.canonical_state(objects, ["note"], {"l": (outer, "o", ["o"], {"m": (inner, "p", ["v"])})}, 4)
        return {r.normalized_key: r.live_checksum for r in out.collect()}

    before, after = prints([]), prints([("db", "a", 0, 9, 9)])
    assert before["a"] != after["a"] and before["b"] == after["b"]


def test_repeated_inner_ordinals_fail(spark):
    outer = spark.createDataFrame([("db", "a", 0)], f"{K}, o int")
    inner = spark.createDataFrame([("db", "a", 0, 1, 1), ("db", "a", 0, 1, 2)], f"{K}, o int, p int, v int")
    with pytest.raises(Exception, match="not unique"):
        fp.child_list(outer, "l", "o", ["o"], lists={"m": (inner, "p", ["v"])}).collect()


def test_lists_picked_by_where_equal_lists_filtered_before(spark):
    rng = random.Random(7)
    outer = spark.createDataFrame([("db", k, i) for k in "abc" for i in range(9)], f"{K}, o int")
    # Ordinals repeat over colours, never within one; some rows have no colour, no key or no entry above.
    inner = [("db", k, i, p, c, p) for k in "abc" for i in range(12) for c in ("red", "blue") for p in rng.sample(range(20), 3)]
    inner += [("db", "c", i, p, None, p) for i in range(9) for p in (3, 3)]
    inner += [("db", None, 1, 1, "red", 1), ("db", "a", None, 1, "red", 1)]
    inner = spark.createDataFrame(inner, f"{K}, o bigint, p int, colour string, v int")
    objects = spark.createDataFrame([("db", k, "tables", k) for k in ("a", "b", "c", "c", None)], f"{K}, kind string, note string")

    def states(lists):
        out = fp.canonical_state(objects, ["note"], {"l": fp.ChildList(outer, "o", ["o"], lists)}, 4)
        return sorted(map(tuple, out.collect()), key=repr)

    rows = fp.ChildList(inner, "p", ["v"])
    picked = {c: rows._replace(where=F.col("colour") == c) for c in ("red", "blue", "none")}
    filtered = {c: rows._replace(rows=inner.filter(F.col("colour") == c)) for c in picked}
    assert states(picked) == states(filtered)
    assert states({"red": picked["red"]}) == states({"red": filtered["red"]})
    with pytest.raises(Exception, match="not unique"):
        states(picked | {"all": rows})
    twice = inner.unionByName(inner.filter("colour = 'red' and p = 3"))
    with pytest.raises(Exception, match="not unique"):
        states({c: w._replace(rows=twice) for c, w in picked.items()})


def test_outer_lists_picked_by_where(spark):
    outer = spark.createDataFrame([("db", "a", i, i % 3) for i in range(9)], f"{K}, o int, m int")
    inner = spark.createDataFrame([("db", "a", i, 0, i) for i in range(9)], f"{K}, o int, p int, v int")
    objects = spark.createDataFrame([("db", "a", "tables", "x")], f"{K}, kind string, note string")
    deep = {"d": (inner, "p", ["v"])}
    lists = fp.ChildList(outer, "o", ["o"], deep)
    state = lambda **by: fp.canonical_state(objects, ["note"], by, 4).first().state
    picked = state(x=lists._replace(where=F.col("m") == 1), y=lists._replace(where=F.col("m") != 1))
    assert picked == state(x=lists._replace(rows=outer.filter("m = 1")), y=lists._replace(rows=outer.filter("m != 1")))


def test_repeated_entries_with_lists_fail(spark):
    outer = spark.createDataFrame([("db", "a", 0), ("db", "a", 0)], f"{K}, o int")
    inner = spark.createDataFrame([("db", "a", 0, 1, 1)], f"{K}, o int, p int, v int")
    with pytest.raises(Exception, match="not unique"):
        fp.child_list(outer, "l", "o", ["o"], lists={"m": (inner, "p", ["v"])}).collect()


def test_nested_state_reads_and_shuffles_its_lines_once(spark, tmp_path):
    import __spark_entry__

    n = 2000
    spark.range(n // 10).select(F.col("id").alias("c_custkey"), F.lit("m").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % (n // 10)).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(4 * n).select(
        (F.col("id") % n).alias("l_orderkey"), F.floor(F.col("id") / n).cast("int").alias("l_linenumber"), F.col("id").alias("l_partkey"),
        F.col("id").alias("l_suppkey"), F.lit(1.0).alias("l_quantity"), F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = __spark_entry__.queries()["e4_nested_state"](spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert sum("l_orderkey" in x for x in scans) == 1 and sum("o_orderkey" in x for x in scans) == 2
    # Lines and orders by order, entries and digests by chunk, chunks and customers by key.
    assert plan.count("Exchange hashpartitioning") == 5
    assert df.count() == n // 10
