"""Closed syncmers against a plain restatement of their rule, scripts, and ranges."""

import random

import xxhash

from reconcile.llm import syncmers

SEED = 42


def _long(value: int, seed: int) -> int:
    return xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), seed)


def _folded(values) -> int:
    h = SEED
    for v in values:
        h = _long(v, h)
    return h


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def brute(words, k=syncmers.K, s=syncmers.S):
    """Every k-mer is looked at alone."""
    h = [xxhash.xxh64_intdigest(w.encode(), SEED) for w in words]
    out = []
    for i in range(len(h) - k + 1):
        inner = [_signed(_folded(h[j : j + s])) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, _signed(_folded(h[i : i + k]))))
    return out or [(0, _signed(_folded(h)))]


def test_anchors_follow_the_rule(spark):
    rng = random.Random(5)
    texts = [[f"t{rng.randrange(9)}" for _ in range(n)] for n in (0, 1, 5, 6, 7, 12, 80, 700)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: [(x.position, x.hash) for x in r.a] for r in syncmers.anchors(df, "text", "a").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    whole = {r.i: r.f for r in syncmers.sketch(df, "text", "f").collect()}
    assert whole == {i: sorted({h for _, h in brute(t)}) for i, t in enumerate(texts)}


def _likeness(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    return syncmers.sketch(syncmers.sketch(df, "a", "x"), "b", "y").select(syncmers.likeness("x", "y")).first()[0]


def test_one_letter_in_front_moves_nothing_far_away(spark):
    rng = random.Random(6)
    thai = "".join(chr(0x0E01 + rng.randrange(46)) for _ in range(400))
    kana = "".join(chr(0x3042 + rng.randrange(60)) for _ in range(400))
    blob = "".join(rng.choice("abcdefghijklmnop0123456789") for _ in range(400))
    for text in (thai, kana, blob):
        assert _likeness(spark, text, text[0] + text) > 0.9
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    assert 0.4 < _likeness(spark, " ".join(words), " ".join(words[:1500])) < 0.6


def _successors(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    return sorted(((*r, ordered[(i + 1) % len(ordered)][1]) for i, r in enumerate(ordered)), key=repr)


def test_hot_and_outlying_ids(spark):
    rng = random.Random(7)
    hot = [(77, f"{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))} {i}") for i in range(300)]
    rows = hot + [(i, f"é{i}") for i in range(0, 600, 2)] + [(None, f"n{i}") for i in range(90)]
    rows += [((1 << 63) - 1, "last"), (-(1 << 63), ""), ((1 << 60) + 1, "far"), ((1 << 60) + 2, "further")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = syncmers.with_next(df, ["doc_id", "text"], range_rows=20)
    assert sorted(((r.doc_id, r.text, r.next_text) for r in out.collect()), key=repr) == _successors(rows)
    bounds, ids = syncmers._bounds(df, 20)
    assert ids == [77] and {77, 78} <= set(bounds)
    place = df.where("doc_id is not null").groupBy(syncmers._place(bounds).alias("p")).count()
    assert max(r["count"] for r in place.collect() if r.p != bounds.index(77) + 1) <= 60
