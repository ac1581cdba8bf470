"""The Merkle manifest, multi-index hashing and periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reconcile.llm import binary_codes, merkle, periodic_runs
from reconcile.session import work_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


# Periodic runs


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, q, length) for (start, length), q in out.items())


def brute_collapsed(w, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng):
    n = rng.choice([0, 1, 23, 24, 80, 200, 400, 700])
    w = [str(rng.randrange(rng.choice([1, 2, 2, 3, 5, 50]))) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 23 else 0):
        a = rng.randrange(n)
        p = 1 + rng.randrange((n - a) // 3 + 1)
        for i in range(a + p, rng.randrange(a, n + 1)):
            w[i] = w[i - p]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    total = 0
    for _ in range(30):
        texts = [repetitive(rng) for _ in range(rng.randrange(1, 8))]
        got = periodic_runs._analysed([" ".join(w).encode() for w in texts])
        for w, (n, runs, collapsed) in zip(texts, got):
            want = brute_runs(w)
            total += len(want)
            assert n == len(w)
            assert [(r["start"], r["period"], r["length"]) for r in runs] == want
            assert collapsed.decode() == brute_collapsed(w, want)
    assert total


def test_runs_of_words_that_overlap_everywhere():
    a, b = "0", "01"
    while len(b) < 900:
        a, b = b, b + a
    got = periodic_runs._analysed([" ".join(b).encode()])[0][1]
    want = brute_runs(list(b))
    assert [(r["start"], r["period"], r["length"]) for r in got] == want and len(want) > 50


def test_runs_query_equals_brute_force_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in periodic_runs.query(spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        w = text.encode().split()
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        w = [x.decode() for x in w]
        runs = brute_runs(w) if len(w) < 3000 else None
        r = got[doc_id]
        if runs is None:
            continue
        some += len(runs)
        assert r.n_runs == len(runs)
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()
        lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        if runs:
            from fractions import Fraction

            s, q, n = min(runs, key=lambda x: (-Fraction(x[2], x[1]), x[0], x[1]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert some > 5


def test_runs_defined_cases(spark, tmp_path):
    long = " ".join(["x y z"] * 40_000)
    rows = [
        (1, None, "k"), (2, "", "k"), (3, " \n\t ", "k"), (None, "a " * 30, "k"), (5, "a b " * 24, "k"),
        (6, long, "k"), (6, long, "k"), (7, "a b " * 12 + "c d " * 12, "k"), (10, None, "k"), (17, "", "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("collapsed", F.lit(1))
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect())
    assert got == [
        (0, 30, [(0, 30, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (5, 24, [(0, 24, 1)], "a b"),
        (6, 120_000, [(0, 120_000, 3)], "x y z"), (6, 120_000, [(0, 120_000, 3)], "x y z"),
        (7, 48, [(0, 24, 2), (24, 24, 2)], "a b c d"), (10, 0, [], ""), (17, 0, [], ""),
    ]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in periodic_runs.query(spark, str(tmp_path)).collect()}
    assert out[1].runs_sha256 == hashlib.sha256(b"").hexdigest() and out[1].n_runs == 0
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []


def test_strongest_run_and_ties(spark):
    runs = "array<struct<start:long,length:long,period:long>>"
    df = spark.createDataFrame([([(5, 30, 3), (1, 20, 2), (0, 24, 3)],), ([],)], f"r {runs}")
    got = [tuple(x.top) if x.top else None for x in df.select(periodic_runs.strongest(F.col("r")).alias("top")).collect()]
    assert got == [(1, 20, 2), None]


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, tamper):
    """doc_id, leaf, subroot, root, witness hex, folded root; rows as (doc_id, text, lang, source, n_chars)."""

    def leaf(doc_id, text, lang, source, n_chars):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            yield i % 3, run[: i % 3] + run[i % 3 + 1 :]
            i //= 3

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {s: levels([leaf(*r) for r in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            way = [*path(trees[s], i), *path(top, j)]
            d = leaf(r[0], tamper(r), *r[2:])
            for at, others in way:
                d = H(*others[:at], d, *others[at:])
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], "".join(x for _, o in way for x in o), d))
    return sorted(out, key=repr)


def manifest_rows(spark, path, **kw):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, bytes(r.witness).hex(), r.folded_root) for r in merkle.proofs(spark, path, **kw).collect()), key=repr)


def corpus(n, seed=0, first=0):
    rng = random.Random(seed)
    names = ["a", "b", None, "é", "", "solo"]
    return [
        (first + i, rng.choice([None, "", "x\ny", "long " * 50]), rng.choice(["en", None]), "a" if i % 3 == 0 else rng.choice(names[:-1]) if i else "solo", rng.choice([None, i]))
        for i in range(n)
    ]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 200])
def test_manifest_equals_brute_force(spark, n):
    rows = corpus(n)
    path = work_path(spark, "m")
    # two levels a block, so that blocks stand below blocks
    docs = spark.createDataFrame(rows, DOC).withColumns({"key": F.lit("k"), "idx": F.lit(1), "digest": F.lit("d")})
    merkle.append(docs, path, F.replace("text", F.lit("\n"), F.lit("")), levels=2)
    want = brute_manifest(rows, lambda r: r[1] and r[1].replace("\n", ""))
    assert manifest_rows(spark, path, levels=2) == want
    bad = merkle.proofs(spark, path, levels=2).where("not verified").count()
    assert bad == sum("\n" in (r[1] or "") for r in rows)


def test_appends_give_the_manifest_of_all_rows(spark):
    path = work_path(spark, "m")
    batches = [corpus(70, 1), corpus(5, 2, 1000), corpus(100, 3, 2000)]
    for b in batches:
        merkle.append(spark.createDataFrame(b, DOC), path, levels=2)
    # an append that stopped before its heads were written counts for nothing
    spark.read.parquet(f"{path}/rows/state=open/batch=2").write.parquet(f"{path}/rows/state=open/batch=3")
    want = brute_manifest(sum(batches, []), lambda r: r[1])
    assert manifest_rows(spark, path, levels=2) == want
    closed = [spark.read.parquet(f"{path}/rows/state=closed/batch={n}").count() for n in range(3)]
    assert closed[0] >= 27 and sum(closed) % 9 == 0
    with pytest.raises(ValueError, match="must follow"):
        merkle.append(spark.createDataFrame(corpus(5, 4, 500), DOC), path, levels=2)
    merkle.append(spark.createDataFrame(corpus(30, 4, 3000), DOC), path, levels=2)
    want = brute_manifest(sum(batches, corpus(30, 4, 3000)), lambda r: r[1])
    assert manifest_rows(spark, path, levels=2) == want


def test_manifest_defined_cases(spark):
    rows = [(None, "a", None, "s", 1), (7, "b", "en", "s", 1), (7, "b", "en", "s", 1), (7, "a" * 100_000, "en", "s", None), (-3, None, None, None, None)]
    path = work_path(spark, "m")
    merkle.append(spark.createDataFrame(rows, DOC), path)
    assert manifest_rows(spark, path) == brute_manifest(rows, lambda r: r[1])
    empty = work_path(spark, "m")
    merkle.append(spark.createDataFrame([], DOC), empty)
    assert merkle.proofs(spark, empty).collect() == []


def test_manifest_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = brute_manifest(rows, lambda r: r[1].replace("\n", "") if zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1])
    got = sorted(map(tuple, merkle.query(spark, SF).collect()))
    assert got == sorted((i, leaf, sub, root, H(w), fold, fold == root) for i, leaf, sub, root, w, fold in want)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


# Multi-index hashing


def brute_nearest(rows, k=5):
    """rows as (vec_id, vector); each query's nearest by cosine, ties to the smaller id."""
    out = {}
    x = [np.array(v, dtype=np.float64) for _, v in rows]
    for i, (q, _) in enumerate(rows):
        if q % 50 == 0:
            near = [(-(x[j] @ x[i]) / np.sqrt((x[j] @ x[j]) * (x[i] @ x[i])), rows[j][0]) for j in range(len(rows)) if j != i]
            out[q] = sorted((round(s, 12), v) for s, v in near)[:k]
    return out


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, size=(3000, 8), dtype=np.uint8)
    codes[1500:] = codes[0] ^ (rng.random((1500, 8)) < 0.3) * rng.integers(0, 256, size=(1500, 8), dtype=np.uint8)
    buckets = binary_codes.Buckets(codes)
    far = np.bitwise_count(buckets.words ^ buckets.words[0]).sum(axis=1)
    for radius in [0, 1, 2, 3, 4, 7, 12, 20, 29, 47, 63, 64]:
        rows, dist = buckets.within(buckets.words[0], radius)
        assert rows.tolist() == np.flatnonzero(far <= radius).tolist()
        assert dist.tolist() == far[rows].tolist()
    assert sum(e + 1 for e in binary_codes.allowed_errors(29, 4)) == 30


def test_learned_rotation_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(500, 24))
    r = binary_codes.learned_rotation(x)
    assert np.allclose(r @ r.T, np.eye(24))


def test_search_recall_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {}
    for r in binary_codes.query(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_nearest(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == [1, 2, 3, 4, 5]
        assert [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)
        hits += len({x[1] for x in found} & {v for _, v in want[q]})
    assert hits >= 0.95 * 5 * len(want)


def test_search_with_planted_neighbours_and_few_bits_apart(spark, tmp_path):
    """Clusters of near vectors: the radius is small and every neighbour is found."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 70))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.1 * rng.normal(size=70)]) for i in range(1200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute_nearest(rows)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in binary_codes.query(spark, str(tmp_path)).collect())
    exact = sorted((q, n + 1, v, round(-s, 9)) for q, near in want.items() for n, (s, v) in enumerate(near))
    assert len(set(got) & set(exact)) >= 0.95 * len(exact) and len(got) == len(exact)


def test_search_defined_cases(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    hot = [1.0, 2.0, 0.0]
    rows = [(i, hot) for i in range(40, 120)]  # copies: ties to the smallest ids
    rows += [(0, [0.0, 0.0, 0.0]), (150, None), (200, [1.0, nan, 0.0]), (250, [1.0, None, 0.0]), (300, [inf, 0.0, 0.0]), (350, []), (400, [1.0, 2.0])]
    rows += [(None, hot), (450, [1e300, 0.0, 1e300]), (451, [-1e-300, 0.0, -1e-300]), (500, hot), (500, [0.0, 0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit(1), "block": F.lit(1), "code": F.lit("c")})
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in binary_codes.query(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {50, 100, 450, 500}
    assert [x[1] for x in got[50]] == [40, 41, 42, 43, 44] and len({x[2] for x in got[50]}) == 1
    assert [x[1] for x in got[100]] == [40, 41, 42, 43, 44]
    assert got[450][0][1] == 500 and abs(got[450][0][2] - 0.5**0.5) < 1e-12
    assert len(got[500]) == 10  # the id stands twice, each row is a query
    few = binary_codes.usable(df.where("vec_id in (450, 500)"))
    out = binary_codes.search(binary_codes.build(few, 5), few.where("vec_id = 450"), 5).collect()
    assert [(r["rank"], r.vec_id) for r in out] == [(1, 500), (2, 500)]
    one = binary_codes.usable(df.where("vec_id = 50"))
    assert binary_codes.search(binary_codes.build(one, 5), one, 5).collect() == []
    none = binary_codes.usable(df.limit(0))
    assert binary_codes.search(binary_codes.build(none, 5), none, 5).collect() == []
