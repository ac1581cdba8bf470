"""Near copies on both sides of the threshold: only pairs that can be linked are compared in full."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from test_llm import brute_components, docs_of

from reconcile.llm import components, hamming_join


def _copies(n, edits, seed=0):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(len(base), edits, replace=False):
            words[at] = f"x{k}-{at}"
        out.append(" ".join(words))
    return out


def test_sketches_differ_in_no_more_bits_than_sets_in_items():
    rng = np.random.default_rng(1)
    for size in (1, 30, 400, 5000):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (size, size // 5, size // 7 + 1))
        x, y = (hamming_join.sketch(np.unique(np.concatenate((both, own)))) for own in (a, b))
        assert sum(int(v).bit_count() for v in (x ^ y).view("<u8")) <= len(a) + len(b)
        assert not (x ^ x).any()


def test_copies_below_the_threshold_are_not_compared_in_full(spark, monkeypatch):
    texts = _copies(60, 8) + _copies(8, 1, seed=5)  # two of the first kind share about 0.6 of their shingles
    compared, confirm = [], hamming_join._confirmed

    def counted(pairs, sets, percent):
        compared.append(pairs.count())
        return confirm(pairs, sets, percent)

    monkeypatch.setattr(hamming_join, "_confirmed", counted)
    got = {r.doc_id: r.component_id for r in hamming_join.near_groups(docs_of(spark, texts), words=2).collect()}
    assert [got[i] for i in sorted(got)] == brute_components(texts, 2)[0]
    assert sum(compared) < 100  # 1,770 pairs of the first kind alone


def test_sketch_condition_keeps_every_link(spark):
    texts = _copies(24, 3, seed=3)
    rows = hamming_join.features(docs_of(spark, texts), 2).where("node is not null")
    side = lambda n: rows.select(*[F.col(c).alias(f"{a}{n}") for c, a in (("node", "node"), ("n_shingles", "n"), ("n_shingles", "common"), ("sig", "sig"), ("sketch", "sketch"))])
    found = {(r.node1, r.node2) for r in side(1).crossJoin(side(2)).where(hamming_join._candidate(80)).collect()}
    sets = [hamming_join.shingles(t, 2) for t in texts]
    ids = [hamming_join._node(s) for s in sets]
    linked = {
        (ids[i], ids[j]) for i in range(24) for j in range(24)
        if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    }
    assert linked and linked <= found


def test_sets_too_far_from_all_others_leave_their_keys(spark, monkeypatch):
    # copies of which no two are linked, one chain of links among them and sets that share less still
    texts = _copies(70, 9) + _copies(12, 2, seed=7) + _copies(30, 20, seed=9)
    open_nodes, exploded, linkable = [], [], hamming_join._linkable

    def counted(members, marks, items, percent):
        exploded.append("items" in items.columns)
        left, items = linkable(members, marks, items, percent)
        open_nodes.append((members.select("node").distinct().count(), left.select("node").distinct().count()))
        return left, items

    monkeypatch.setattr(hamming_join, "_linkable", counted)
    got = {r.doc_id: r.component_id for r in hamming_join.near_groups(docs_of(spark, texts), words=2).collect()}
    want = brute_components(texts, 2)[0]
    assert [got[i] for i in sorted(got)] == want and len(set(want)) < len(texts)
    assert open_nodes and all(left < open_ for open_, left in open_nodes[:1])
    assert exploded == [True] + [False] * (len(exploded) - 1)  # full sets only once


def test_members_carry_no_sketches_between_joins(spark, monkeypatch):
    tables, write = {}, hamming_join.written

    def kept(df, name):
        tables.setdefault(name, set()).update(df.columns)
        return write(df, name)

    monkeypatch.setattr(hamming_join, "written", kept)
    hamming_join.near_groups(docs_of(spark, _copies(30, 9)), words=2).collect()
    assert all(not {"sig", "sketch"} & tables[t] for t in ("members", "open", "meeting"))


def test_items_meet_their_component_once_per_set(spark, monkeypatch):
    # each round reads one row per open set, not one per item; only sets that may still be linked stay
    texts = _copies(70, 9) + _copies(12, 2, seed=7) + _copies(30, 20, seed=9)
    rounds, linkable = [], hamming_join._linkable

    def counted(members, marks, items, percent):
        left, items = linkable(members, marks, items, percent)
        rounds.append((items.count(), left.select("node").distinct().count(), members.select("node").distinct().count()))
        return left, items

    monkeypatch.setattr(hamming_join, "_linkable", counted)
    hamming_join.near_groups(docs_of(spark, texts), words=2).collect()
    assert rounds and all(rows == nodes <= before for rows, nodes, before in rounds)


def test_rounds_write_few_files_and_items_are_bounded_once(spark, monkeypatch):
    # with many shuffle partitions a table of a few rows isn't written, and read again, in as many tasks
    texts = _copies(70, 9) + _copies(12, 2, seed=7) + _copies(30, 20, seed=9)
    cores, files, bounded, linkable = spark.sparkContext.defaultParallelism, {}, [], hamming_join._linkable

    def counted(write):
        def run(df, name):
            out = write(df, name)
            files[name] = max(files.get(name, 0), len(out.inputFiles()))
            return out

        return run

    for module in (hamming_join, components):
        monkeypatch.setattr(module, "written", counted(module.written))
    monkeypatch.setattr(hamming_join, "_linkable", lambda *args: bounded.append(args) or linkable(*args))
    settings = {"spark.sql.shuffle.partitions": str(12 * cores), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in hamming_join.near_groups(docs_of(spark, texts), words=2).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [got[i] for i in sorted(got)] == brute_components(texts, 2)[0]
    assert {"members", "open", "meeting", "pairs", "edges", "labels"} <= set(files)
    assert all(n <= 4 * cores for name, n in files.items() if name not in ("features", "sets", "named")), files
    assert len(bounded) == 1
