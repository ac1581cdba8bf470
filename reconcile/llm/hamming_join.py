"""Near-duplicate detection by a multi-index Hamming join over b-bit MinHash.

A document's set holds its distinct word shingles. Its signature has
``CHUNKS * SYMBOLS`` minima, each cut to ``BITS`` bits. Signatures are split into
chunks; by pigeonhole two signatures that differ in at most
``CHUNKS * (ERRORS + 1) - 1`` places agree on some chunk up to ``ERRORS`` places,
so every chunk is indexed once for each choice of ``ERRORS`` places left out, and
such pairs always meet under a key. At a likeness of 0.8 a pair misses all keys
with probability 1e-6; pairs that meet beyond the guarantee are checked as well.
Links are confirmed on full shingle sets.

Equal sets are one node. A key's members are not paired with each other. Under
the keys of the first chunk each meets one member; links are confirmed and
contracted into components. From then on only keys with several components are
looked at: a few members meet those of other components, first from the key's
largest component, then from outside it in growing numbers, with a contraction
after each round, until no key holds two components that haven't met. After the first
rounds a set whose items are too rarely held outside its component to reach the
likeness with any set leaves its keys. A key with thousands of near copies is done
after a few linear rounds, and no link is lost.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Defined cases: fewer
words than a shingle: the whole sequence is one shingle; no words or null text:
an empty set, linked with nothing. One row of each component is kept, the first
by (doc_id, row) with rows without doc_id last; rows that repeat a doc_id are
judged by their own text. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations, count
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import worker
from .components import components, free, gathered, written

CHUNKS, SYMBOLS, ERRORS, BITS = 8, 4, 1, 16
SLOTS = CHUNKS * SYMBOLS
#: 64-bit words of a set's sketch, which holds for each bit whether an odd number of items falls on it.
SKETCH = 16
#: Pairs that agree in fewer places aren't confirmed: at a likeness of 0.8 the chance is 1e-8.
LEAST_EQUAL = 12
#: Row number of tables that are read more than once; made by the place in the table where it is missing.
ROW = "__row"
SPACES = b" \t\n\v\f\r"
#: Members of a key that meet the others in one round; rounds in which they come from the largest component.
MEETING, INNER_ROUNDS = 4, 2

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _rng.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Powers:
    """Powers of the rolling base and its inverse, as long as the longest text so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up, cls.down


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").translate(_LOWER), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    space = np.concatenate(([True], _SPACE[raw], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _Powers.to(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = _mix(out * np.uint64(0xA0761D6478BD642F) + h[j : len(h) - n + 1 + j])
    if n < words:
        out = out + np.uint64(n)  # a short sequence differs from a shingle
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        low = np.minimum(low, (part * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1))
    return (_mix(low) & np.uint64(2**BITS - 1)).astype(np.int32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the items per bit; two sketches differ in at most as many bits as their sets in items."""
    odd = np.bincount((_mix(hashes) >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _node(hashes: np.ndarray) -> int | None:
    if not len(hashes):
        return None
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row, key, n_shingles, node (one id for each distinct set; null for empty), sig and sketch."""

    def run(batches):
        worker.enter("near copies")
        for b in batches:
            sets = [shingles(t, words) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"),
                "row": b["row"],
                "key": b["key"],
                "n_shingles": [len(h) for h in sets],
                "node": pd.array([_node(h) for h in sets], dtype="Int64"),
                "sig": [signature(h).astype(np.uint16).view(np.int16) if len(h) else None for h in sets],
                "sketch": [sketch(h) if len(h) else None for h in sets],
            })
        worker.release()

    columns = "doc_id long, row long, key long, n_shingles long, node long, sig array<smallint>, sketch array<bigint>"
    return _keyed(docs).mapInPandas(run, columns)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"),
        (F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()).alias("row"),
    )


def _sets(docs: DataFrame, owners: DataFrame, words: int) -> DataFrame:
    """node and its full set for the nodes of ``owners`` (node, key), from the text of one row each."""

    def run(batches):
        worker.enter("near copies")
        for b in batches:
            found = [(n, h) for n, t in zip(b["node"], b["text"]) if _node(h := shingles(t, words)) == n]
            yield pd.DataFrame({"node": [n for n, _ in found], "items": [h.view(np.int64) for _, h in found]})
        worker.release()

    return _keyed(docs).join(owners, "key").select("node", "text").mapInPandas(run, "node long, items array<long>")


def chunk_keys() -> list:
    """Index keys of a signature column ``sig``: each chunk, each choice of places left out."""
    keys = []
    for c in range(CHUNKS):
        for left_out in combinations(range(SYMBOLS), ERRORS):
            places = [c * SYMBOLS + j for j in range(SYMBOLS) if j not in left_out]
            keys.append(F.xxhash64(F.lit(len(keys)), *[F.get("sig", F.lit(p)) for p in places]))
    return keys


def _candidate(percent: int):
    """Condition on two members (suffix 1 and 2): sizes, sketches and signatures allow a link."""
    # what two sets share is at most what either shares with any other open set
    shared = F.lit(100 + percent) * F.least("common1", "common2") >= F.lit(percent) * (F.col("n1") + F.col("n2"))
    # bits in which the sketches differ: no more than items that only one of the sets holds
    apart = reduce(add, [F.bit_count(F.get("sketch1", F.lit(w)).bitwiseXOR(F.get("sketch2", F.lit(w)))) for w in range(SKETCH)])
    equal = F.aggregate(F.zip_with("sig1", "sig2", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (
        (F.lit(100) * F.least("n1", "n2") >= F.lit(percent) * F.greatest("n1", "n2"))
        & (F.col("node1") != F.col("node2"))
        & shared
        & (F.lit(100 + percent) * apart <= F.lit(100 - percent) * (F.col("n1") + F.col("n2")))
        & (equal >= LEAST_EQUAL)
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) whose full sets reach the likeness."""
    # written, so that Spark knows how few they are and moves no other sets
    pairs = written(gathered(pairs), "pairs")
    ends = lambda end: sets.join(pairs.select(F.col(end).alias("node")), "node", "left_semi")
    left = ends("a").select(F.col("node").alias("a"), F.col("items").alias("a_items"))
    right = ends("b").select(F.col("node").alias("b"), F.col("items").alias("b_items"))
    both = F.size(F.array_intersect("a_items", "b_items"))
    either = F.size("a_items") + F.size("b_items") - both
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(F.lit(100) * both >= F.lit(percent) * either).select("a", "b")


def _side(members: DataFrame, marks: DataFrame, n: int, *more: str) -> DataFrame:
    """``members`` (key, node) with what a comparison looks at, from ``marks`` (node, n, sig, sketch)."""
    marked = members.join(marks, "node")
    if "common" not in members.columns:
        marked = marked.withColumn("common", F.col("n"))
    return marked.select("key", *[F.col(c).alias(f"{c}{n}") for c in ("node", "n", "common", "sig", "sketch", *more)])


def _open(named: DataFrame) -> DataFrame:
    """The rows of ``named`` (key, node, component) under keys that hold several components, with the key's ``largest``."""
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    ranges = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("several"), F.max_by("component", F.struct("size", "component")).alias("largest")
    )
    return named.join(ranges.where("several > 1").select("key", "largest"), "key")


def _linkable(members: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``members`` (key, node, component) that may have a link to another component, with ``common``;
    and one row (node, common) per node left.

    ``common`` is how many items of the node's set are held by members of other components: no
    link shares more, and a set that shares less than its part of the likeness has none. Components
    only merge and members only leave, so it stays a bound in all later rounds.
    """
    held = written(gathered(members.select("node", "component").distinct()), "held")
    items = sets.join(held, "node").select("node", "component", F.explode("items").alias("item"))
    holders = items.groupBy("item").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    shared = items.join(holders.where("low < high").select("item"), "item").groupBy("node").agg(F.count(F.lit(1)).alias("common"))
    common = shared.join(marks.select("node", "n"), "node")
    enough = F.lit(100) * F.col("common") >= F.lit(percent) * F.col("n")
    left = written(gathered(common.where(enough).select("node", "common")), "common")
    # written, as finding the keys still open reads it twice
    return written(gathered(members.join(left, "node")), "linkable"), left


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after joining the components that ``links`` connect."""
    a = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    ab = a.join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    moved = components(ab.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = moved.select(F.col("component").alias("to"), F.col("node").alias("component"))
    # components of one node so far have no label yet
    known = labels.select("component").distinct()
    new = moved.join(known, "component", "left_anti").select(F.col("component").alias("node"), F.col("to").alias("component"))
    renamed = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return written(gathered(renamed.union(new)), "labels")


def _linked(members: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of all nodes with a link, from ``members`` (key, node, chunk).

    Only the two sides of a join carry signatures and sketches."""
    pair = lambda df: df.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
    # one member per key of the first chunk meets the others; most copies are joined here
    chunk = members.where("chunk = 0").select("key", "node")
    first = chunk.groupBy("key").agg(F.min("node").alias("node"))
    pairs = pair(_side(chunk, marks, 1).join(_side(first, marks, 2), "key").where(_candidate(percent)))
    labels = components(_confirmed(pairs, sets, percent))
    members = members.select("key", "node").join(first, ["key", "node"], "left_anti")
    for round_ in count():
        # all rows of keys that still hold nodes of several components
        named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = written(gathered(_open(named)), "open")
        inner = round_ < INNER_ROUNDS
        if round_ == INNER_ROUNDS and not open_.isEmpty():
            # few sets are left: an exact bound on what a set can share spares most of them
            linkable, _ = _linkable(open_.drop("largest"), marks, sets, percent)
            open_ = written(gathered(_open(linkable)), "open")
        if open_.isEmpty():
            return labels
        # members of the largest component meet the few outside it; those that
        # stay outside after some rounds then meet all others, ever more at once
        outside = F.col("component") != F.col("largest")
        meeting = MEETING if inner else MEETING ** (round_ - INNER_ROUNDS + 1)
        order = Window.partitionBy("key").orderBy(outside if inner else ~outside, "node")
        few = open_.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= meeting)
        # later a node that meets all others does so under all its keys at once, and only once
        by = ["key", "node"] if inner else ["node"]
        few = written(gathered(few.select(by).distinct()), "meeting")
        open_ = open_.drop("largest")
        pairs = pair(
            _side(open_, marks, 1, "component").join(_side(open_.join(few, by, "left_semi"), marks, 2, "component"), "key")
            .where((F.col("component1") != F.col("component2")) & _candidate(percent))
        )
        labels = _merged(labels, _confirmed(pairs, sets, percent))
        # written, as finding the keys still open reads it twice
        members = written(gathered(open_.drop("component").join(few, by, "left_anti")), "members")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, row.

    Documents are linked when their shingle sets of ``words`` words reach a
    Jaccard likeness of ``percent`` / 100; a component is named by its smallest doc_id.
    ``row`` names a column of written row numbers; without it rows are numbered here.
    """
    docs = docs.select("doc_id", "text", *([F.col(row).alias(ROW)] if row else []))
    rows = written(features(docs, words), "features")
    nodes = written(
        rows.where("node is not null").groupBy("node")
        .agg(F.min("key").alias("owner"), F.max("n_shingles").alias("n"), F.any_value("sig").alias("sig"), F.any_value("sketch").alias("sketch"))
        .transform(gathered),
        "nodes",
    )
    keys = nodes.select("node", F.posexplode(F.array(*chunk_keys())).alias("place", "key"))
    keys = keys.select("node", "key", F.expr(f"place div {len(chunk_keys()) // CHUNKS}").cast("int").alias("chunk"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    members = written(gathered(keys.join(shared, "key")), "members")
    marks = written(gathered(nodes.join(members.select("node").distinct(), "node")), "marks")
    sets = written(_sets(docs, marks.select("node", F.col("owner").alias("key")), words), "sets")
    labels = _linked(members, marks.drop("owner"), sets, percent)
    named = rows.drop("sig", "sketch", "key").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    first = named.where("component is not null").groupBy("component").agg(F.min(order).alias("first"))
    named = written(named, "named")
    out = named.join(first, "component", "left")
    alone = F.col("component").isNull()
    return out.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"), "row",
    )


def drop_near(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns kept.

    The rows are written once with a row number, by which they are dropped.
    """
    row = free(docs, ROW)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    gone = near_groups(rows, words, percent, row).where("not kept").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2).drop("row")
