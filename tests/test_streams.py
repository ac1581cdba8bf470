"""State kept by streams: latest audit rows, and suspects against a moving log."""

import datetime as dt
import random

from pyspark.sql import functions as F

from reconcile import KEY
from reconcile.operators import drift as dr, history as hs
from reconcile.streaming import changes as ch, tail

K = "database_name string, normalized_key string"
LOG = f"id long, {K}, kind string, checksum string, live_definition_checksum string, applied_ddl_version long, event string"
START = dt.datetime(2024, 1, 1)


def log_rows(rng, first, n):
    hot = lambda: "k0" if rng.random() < 0.4 else f"k{rng.randrange(9)}"
    return [
        (first + i, "d", hot(), rng.choice(["object", "object", "migration"]), f"c{first + i}", None, rng.randrange(100), rng.choice(["applied", "adopted", "failed"]))
        for i in range(n)
    ]


def test_latest_rows_from_the_state_store_across_restarts(spark, tmp_path):
    rng = random.Random(5)
    log, mark = str(tmp_path / "log"), str(tmp_path / "cp")
    batches = []
    for b in range(4):
        # the last batch holds older ids too, which must not win
        batches.append(log_rows(rng, 1000 * b, 30) if b < 3 else log_rows(rng, 500, 30))
        spark.createDataFrame(batches[b], LOG).coalesce(1).write.mode("append").parquet(log)
        # another run on the same checkpoint each time
        tail.keep_latest_history(spark.readStream.schema(LOG).parquet(log), mark).awaitTermination()
        seen = spark.createDataFrame(sum(batches, []), LOG)
        want = sorted(map(tuple, hs.latest_object_history(seen).collect()))
        assert sorted(map(tuple, tail.latest_from_state(spark, mark).collect())) == want
    # one row a key, whatever the number of batches
    assert tail.latest_from_state(spark, mark).count() == len(want) <= 9
    # as of an earlier batch
    early = hs.latest_object_history(spark.createDataFrame(batches[0] + batches[1], LOG))
    assert sorted(map(tuple, tail.latest_from_state(spark, mark, 1).collect())) == sorted(map(tuple, early.collect()))
    # keys that moved between two batches, with what they moved to
    moved = sorted(map(tuple, tail.changed_in_state(spark, mark, 1, 2).collect()))
    both = hs.latest_object_history(spark.createDataFrame(sum(batches[:3], []), LOG)).filter("id >= 1000")
    assert moved == sorted(map(tuple, both.collect())) and moved


def test_state_is_read_in_a_session_without_these_settings(spark, tmp_path):
    log, mark = str(tmp_path / "log"), str(tmp_path / "cp")
    spark.createDataFrame(log_rows(random.Random(1), 0, 50), LOG).write.parquet(log)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        tail.keep_latest_history(spark.readStream.schema(LOG).parquet(log), mark).awaitTermination()
        got = sorted(map(tuple, tail.latest_from_state(spark, mark).collect()))
        assert len(tail.changed_in_state(spark, mark, 0, 0).collect()) == len(got)
    finally:
        spark.conf.set(name, before)
    assert got == sorted(map(tuple, hs.latest_object_history(spark.read.parquet(log)).collect()))


EVENTS = f"{K}, ddl_version long, ts timestamp"
AUDITS = f"{K}, applied_ddl_version long, created_at timestamp"


def at(hours):
    return START + dt.timedelta(hours=hours)


def uncleared(spark, tmp_path, events, audits, **kw):
    """What is given out when each step adds a file to both streams and runs on."""
    paths = str(tmp_path / "events"), str(tmp_path / "audits")
    schemas = EVENTS, AUDITS
    out, mark = str(tmp_path / "out"), str(tmp_path / "cp")
    for step in range(max(len(events), len(audits))):
        for files, path, schema in zip((events, audits), paths, schemas):
            rows = files[step] if step < len(files) else []
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        streams = [spark.readStream.schema(s).parquet(p) for s, p in zip(schemas, paths)]
        left = ch.stream_uncleared(*streams, **kw)
        left.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    return sorted((r.normalized_key, r.ddl_version) for r in spark.read.schema(left.schema).parquet(out).collect())


def clock(hours):
    return ("", "", 0, at(hours))


def test_a_later_audit_row_clears_a_suspect(spark, tmp_path):
    events = [
        [("d", "cleared_later", 5, at(1)), ("d", "cleared_before", 5, at(1)), ("d", "older_version", 5, at(1)), ("d", "never", 5, at(1)),
         ("d", "outside", 5, at(1)), ("x", "other_database", 5, at(1)), ("d", "twice", 5, at(1)), ("d", "twice", 9, at(2))],
        [], [clock(100)], [("d", "late_event", 5, at(3)), clock(101)], [clock(400)],
    ]
    audits = [
        [("d", "cleared_before", 7, at(0))],
        [("d", "cleared_later", 5, at(3)), ("d", "older_version", 4, at(3)), ("d", "outside", 5, at(90)), ("d", "other_database", 6, at(2)), ("d", "twice", 6, at(3))],
        [clock(100)], [("d", "never", 6, at(2)), clock(101)], [clock(400)],
    ]
    got = uncleared(spark, tmp_path, events, audits, horizon="24 hours", lateness="1 hour")
    # the late audit row of "never" came when it was settled; the late event isn't reported
    assert [g for g in got if g[0]] == [("never", 5), ("older_version", 5), ("other_database", 5), ("outside", 5), ("twice", 9)]


def test_the_stream_ends_at_the_batch_answer(spark, tmp_path):
    rng = random.Random(7)
    keys = [f"k{i}" for i in range(12)]
    events = [[("d", rng.choice(keys + ["k0"] * 6), 10 * t + rng.randrange(9), at(t)) for t in range(8 * b, 8 * b + 8)] for b in range(3)]
    audits = [[("d", rng.choice(keys), 10 * t + rng.randrange(9), at(t)) for t in range(8 * b, 8 * b + 8)] for b in range(3)]
    got = uncleared(spark, tmp_path, events + [[clock(500)]], audits + [[clock(500)]], horizon="48 hours", lateness="48 hours")
    log = spark.createDataFrame([(i, *a[:2], "object", "c", None, a[2], "applied") for i, a in enumerate(sum(audits, []))], LOG)
    latest = hs.latest_object_history(log)
    ddl = spark.createDataFrame(sum(events, []), EVENTS).groupBy(*KEY).agg(F.max("ddl_version").alias("ddl_version"))
    want = {r.normalized_key for r in dr.suspects(latest, ddl).filter("suspect").collect()}
    recorded = {r.normalized_key for r in latest.collect()}
    assert {k for k, _ in got} & recorded == want and want
