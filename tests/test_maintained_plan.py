"""A plan kept up by the change stream equals the full plan after every batch."""

import random

import pytest

from reconcile import KEY
from reconcile.plans import maintained as mp
from reconcile.plans.reconciliation import compute_plan
from reconcile.sources.versions import VersionLog

K = "database_name string, normalized_key string"
EVENTS = "database_name string, event_type string, schema_name string, object_name string, version long, ts timestamp"


def world(spark, seed, n=40):
    rng = random.Random(seed)
    kinds = ["tables", "triggers", "views"]
    rows = [(f"d{i % 2}", "s", kinds[i % 3], f"o{i}") for i in range(n)]
    key = lambda r: f"{r[1]}/{r[2]}/{r[3]}"
    manifest = [(r[0], key(r), *r[1:], f"{r[0]}/{key(r)}.sql", f"{i:064x}") for i, r in enumerate(rows)]
    # most triggers share one parent
    parent = lambda r: "o0" if rng.random() < 0.6 else f"o{3 * rng.randrange(n // 3)}"
    catalog = [(r[0], key(r), *r[1:], parent(r) if r[2] == "triggers" else None) for i, r in enumerate(rows) if i % 7]
    catalog += [("d0", key(rows[0]), *rows[0][1:], None)]
    latest = [(r[0], key(r), i, rng.choice([f"{i:064x}", "f" * 64, ""]), "a" * 64, rng.randrange(50)) for i, r in enumerate(rows) if i % 5]
    live = [(r[0], key(r), rng.choice(["a" * 64, "b" * 64])) for r in rows]
    m = spark.createDataFrame(manifest, f"{K}, schema_name string, kind string, object_name string, object_path string, checksum string")
    c = spark.createDataFrame(catalog, f"{K}, schema_name string, kind string, object_name string, parent_name string")
    h = spark.createDataFrame(latest, f"{K}, id long, checksum string, live_definition_checksum string, applied_ddl_version long")
    t = spark.createDataFrame([("d0", "s/tables/o6", 1)], f"{K}, ordinal int")
    fingerprints = spark.createDataFrame(live, f"{K}, live_checksum string")
    return rows, mp.Inputs(m, c, h, t, lambda keys: fingerprints.join(keys, KEY, "left_semi"))


def rows_of(df):
    return sorted(map(repr, df.select(*mp.PLAN_COLUMNS).collect()))


def full(inputs, versions):
    return compute_plan(inputs.manifest, inputs.catalog, None, versions, inputs.transitions, inputs.live, latest=inputs.latest)


def test_stream_keeps_the_plan(spark, tmp_path):
    objects, inputs = world(spark, 1)
    path, src = str(tmp_path / "plan"), tmp_path / "events"
    versions = spark.createDataFrame([], f"{K}, ddl_version long")
    mp.create_plan(full(inputs, versions), path, buckets=8)
    rng = random.Random(2)
    events, seen = [], {}
    for batch in range(3):
        # the last batch has an older version of the first object and one nobody manages
        picked = rng.sample(objects[1:], 4) + ([objects[0]] if batch < 2 else [objects[0], ("d0", "s", "views", "stranger")])
        new = [(o[0], f"ALTER_{o[2][:-1].upper()}", "S", o[3].upper(), 90 if batch < 2 else 1, None) for o in picked]
        events.append(new)
        spark.createDataFrame(new, EVENTS).coalesce(1).write.parquet(str(src / f"b={batch}"))
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(src))
        mp.maintain(stream, path, str(tmp_path / "cp"), inputs).awaitTermination()
        for e in new:
            seen[e[0], e[3].lower()] = max(seen.get((e[0], e[3].lower()), 0), e[4])
        now = spark.createDataFrame(
            [(o[0], f"s/{o[2]}/{o[3]}", seen[o[0], o[3]]) for o in objects if (o[0], o[3]) in seen], f"{K}, ddl_version long"
        )
        assert rows_of(mp.read_plan(spark, path)) == rows_of(full(inputs, now)), batch
        # rewritten rows: the closure of the batch and nothing else
        reached = {tuple(r) for r in spark.read.parquet(f"{path}/affected/batch_id={batch}").collect()}
        parents = {(r.database_name, r.normalized_key): (r.database_name, f"s/tables/{r.parent_name}") for r in inputs.catalog.filter("parent_name is not null").collect()}
        tables = {(r.database_name, r.normalized_key) for r in inputs.manifest.filter("kind = 'tables'").collect()}
        own = {(o[0], f"s/{o[2]}/{o[3]}") for o in picked if o in objects}
        assert reached == own | {parents[k] for k in own if k in parents and parents[k] in tables} | {k for k, p in parents.items() if p in own}
        assert mp.recompute(spark.createDataFrame(list(reached), K), inputs, now).count() == len(reached)
    assert VersionLog(spark, path).latest() == 3
    # earlier versions stay readable
    assert rows_of(mp.read_plan(spark, path, 0)) == rows_of(full(inputs, versions))


def test_replayed_batches_and_keys_that_vanish(spark, tmp_path):
    _, inputs = world(spark, 3)
    path = str(tmp_path / "plan")
    none = spark.createDataFrame([], f"{K}, ddl_version long")
    mp.create_plan(full(inputs, none), path, buckets=4)
    before = rows_of(mp.read_plan(spark, path))
    gone = inputs.manifest.select(*KEY).limit(3)
    keys = spark.createDataFrame(gone.collect(), K)
    assert mp.merge_plan(spark, path, keys, mp.read_plan(spark, path).limit(0), 5)
    left = rows_of(mp.read_plan(spark, path))
    assert len(left) == len(before) - 3 and set(left) < set(before)
    assert not mp.merge_plan(spark, path, keys, mp.read_plan(spark, path).limit(0), 5)
    assert VersionLog(spark, path).latest() == 1
    everything = mp.read_plan(spark, path).select(*KEY)
    assert mp.merge_plan(spark, path, everything, mp.read_plan(spark, path).limit(0), 6)
    assert mp.read_plan(spark, path).collect() == []
    assert mp.merge_plan(spark, path, inputs.manifest.select(*KEY), mp.read_plan(spark, path, 0), 7)
    assert rows_of(mp.read_plan(spark, path)) == before
    with pytest.raises(ValueError, match="already"):
        mp.create_plan(full(inputs, none), path)


def test_version_numbers_are_taken_once(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "v"))
    assert log.latest() is None
    assert log.take(0, {"a": 1}) and not log.take(0, {"a": 2})
    assert log.read(0) == {"a": 1} and log.latest() == 0
    # a faster writer takes the number while this one prepares; it starts over
    tries = []

    def prepare(last):
        tries.append(last)
        if len(tries) == 1:
            VersionLog(spark, str(tmp_path / "v")).take(1, {"by": "other"})
        return {"after": last}

    assert log.publish(prepare) == 2 and tries == [0, 1]
    assert log.read(2) == {"after": 1} and log.publish(lambda last: None) == 2
