"""Percentiles and frame totals where one group holds most rows."""

import random

from reconcile.operators import telemetry as tm


def _ranked(walls, q):
    ordered = sorted(walls, key=lambda w: (w is not None, w or 0))
    found = ordered[min(len(ordered) - 1, int(q * len(ordered)))]
    return found if found is not None else min((w for w in walls if w is not None), default=None)


def test_percentiles_in_two_passes(spark):
    rng = random.Random(11)
    groups = {
        "hot": rng.sample(range(10**7), 4000) + [5] * 300,
        "tied": [7] * 50,
        "one": [1 << 40],
        "wide": [0, 1 << 40, (1 << 40) + 1, 15, 16, 17],
        "gaps": [None] * 5 + [3, 400, 90, 16, 31, 32],
        "blank": [None, None],
        None: [rng.randrange(100) for _ in range(99)],
    }
    runs = [(g, w, i % 7 == 0) for g, walls in groups.items() for i, w in enumerate(walls)]
    df = spark.createDataFrame(runs, "mode string, wall_ms long, failed boolean").repartition(5)
    qs = (0.0, 0.1, 0.5, 0.95, 1.0)
    for bucket in (1, 16, 5000, tm.BUCKET_MS):
        got = tm.latency_summary(df, ["mode"], qs, bucket).collect()
        assert {r["mode"] for r in got} == set(groups) and len(got) == len(groups)
        for r in got:
            walls = groups[r["mode"]]
            assert [r[f"p{int(q * 100)}"] for q in qs] == [_ranked(walls, q) for q in qs], (bucket, r)
            assert r.n == len(walls) and r.failures == -(-len(walls) // 7)
            assert r.max == max((w for w in walls if w is not None), default=None)


def test_no_ordered_pass_over_a_whole_group(spark):
    """Every window reads buckets, or the values of one bucket."""
    walls = spark.range(200_000).selectExpr("'a' as mode", "id * 50 as wall_ms", "false as failed")
    r = tm.latency_summary(walls, ["mode"]).first()
    assert (r.n, r.p50, r.p95, r.max) == (200_000, 100_000 * 50, 190_000 * 50, 199_999 * 50)
    assert tm.latency_summary(walls.limit(0), ["mode"]).count() == 0


def test_frame_totals_read_the_stacks_once(spark):
    frames = spark.createDataFrame(
        [(0, "0x1: main (a.rs:1)"), (1, "0x2: own::x (a.rs:2)"), (2, "0x3: own::y (b.rs:3)"), (3, "0x4: libc (c)")],
        "frame_id long, frame string",
    )
    stacks = [(i, 10, [0, 1, 2, 1, 3]) for i in range(50)] + [(90, 7, [0, 3]), (91, 5, []), (92, 3, [1]), (93, 2, [9])]
    points = spark.createDataFrame(stacks, "point_id long, bytes long, frames array<long>")
    out = tm.frame_totals(points, frames, ["own::"], "main")
    got = {(r["view"], r.frame): r.bytes for r in out.collect()}
    assert got == {
        ("inclusive", "own::x (a.rs:2)"): 1003, ("inclusive", "own::y (b.rs:3)"): 500,
        ("deepest", "own::x (a.rs:2)"): 503,
        ("leaf", "libc (c)"): 507, ("leaf", "own::x (a.rs:2)"): 3, ("leaf", "<frame 9>"): 2,
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and plan.count("Window [max") == 1


def test_one_parent_with_a_third_of_all_children(spark):
    from pyspark.sql import functions as F

    from reconcile.operators import catalog as ct
    from reconcile.operators.skew import spread_join

    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3000 == 1, None).otherwise(F.col("id") % 5000)
    left = spark.range(30_000).select("id", key.alias("k"))
    right = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    right = right.unionByName(right.filter("k < 3").withColumn("x", F.lit(-1).cast("long")))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        for how in ("inner", "left"):
            assert sorted(map(tuple, spread_join(left, right, ["k"], how).collect()), key=repr) == sorted(
                map(tuple, left.join(right, "k", how).collect()), key=repr)
        tasks = spread_join(left, right, ["k"]).groupBy(F.spark_partition_id()).count().collect()
        sizes = sorted(r["count"] for r in tasks)
        assert len(sizes) == 16 and sizes[-1] <= 3 * sizes[8]
        objects = spark.range(3000).select(
            F.lit("d").alias("database_name"), F.col("id").alias("object_id"), F.format_string("O%d", "id").alias("object_name"),
            F.when(F.col("id") > 0, F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") - 1)).alias("parent_object_id"))
        plain, cut = ([tuple(r) for r in ct.catalog_parents(objects, spread=s).orderBy("object_id").collect()] for s in (False, True))
        assert sorted(plain, key=repr) == sorted(cut, key=repr) and len(cut) == 3000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
