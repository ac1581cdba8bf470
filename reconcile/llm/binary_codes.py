"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors become codes of one bit per component: the sign after a rotation that is
learned on a sample, so that rotated vectors lie near the corners of the cube. Codes
are split into substrings of ``WIDTH`` bits and each substring has its own table of
buckets. If two codes differ in at most ``radius`` bits, the allowed errors of the
substrings are dealt so that one of them at least is met (pigeonhole): probing the
buckets within the allowed error of each substring retrieves every code within the
radius, and no other is kept. What is retrieved is ranked by the cosine of the
original vectors in double precision.

The radius is measured: for a bounded number of pilot queries the true neighbours
among all rows are found by scanning, and the radius is the Hamming distance within which
the share ``recall`` of them lies. A query with too few rows in its radius is searched
again with twice the radius, until it has as many as there are.

Scale: every row is indexed. The index is a table dealt into blocks; a task builds the bucket
tables of one block and probes them for one group of queries, so memory is bounded by
the block and the group, whatever code is common. Queries travel to each block, blocks to
each group, and only the ``k`` best of a query and block come back. Equal vectors share
one code and one score, so of each group of equal vectors the index holds the
``k + 1`` smallest ids, which are all that can be returned. Only the sample for the
rotation (``SAMPLE`` rows) and the distances of the pilots reach the driver.

Defined cases: vectors that are null, zero or hold a null or non-finite component, rows without vec_id,
and vectors of another length than the most frequent one (of equals the smallest)
take no part. Rows are told apart by their place in the table, so a repeated
vec_id is several candidates and several queries; ties go to the smaller vec_id. With
fewer than ``k`` candidates all are returned; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import written

#: Bits of a substring.
WIDTH = 16
#: Rows the rotation is learned on, and bytes of them, at most.
SAMPLE, SAMPLE_BYTES = 4096, 64 << 20
#: Queries whose true neighbours are found by scanning, at most.
PILOTS = 200
#: Rows of a block and queries of a group, at most; fewer where vectors are long.
BLOCK, GROUP, BLOCK_BYTES = 65_536, 32_768, 64 << 20
#: Rows of a block, at least, before there are more blocks than tasks that can run.
LEAST_BLOCK = 4096

FOUND = "query_row long, query_id long, row long, vec_id long, score double, bits int"


@dataclass(frozen=True)
class Index:
    """``table``: block, row, vec_id, vector, code. ``rows``: candidates before equal ones are merged."""

    table: DataFrame
    rotation: np.ndarray
    blocks: int
    rows: int


def usable(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """row, vec_id, vector of the rows that take part; a written table."""
    element = "float" if vectors.schema[name].dataType.elementType.simpleString() == "float" else "double"
    v = F.col("vector")
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col(name).cast(f"array<{element}>").alias("vector")
    )
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    some = F.exists(v, lambda x: x != 0)
    rows = written(rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & some), "vectors")
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return rows.where(F.size("vector") == (size["n"] if size else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows of doubles, scaled by powers of two so that squares neither overflow nor vanish."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def learned_rotation(x: np.ndarray, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """The rotation whose signs lose least: principal axes, then rotation and signs in turn."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(x.T @ x)[1]
    v = x @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        signs = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, wt = np.linalg.svd(v.T @ signs)
        r = u @ wt
    return axes @ r


def build(rows: DataFrame, k: int, sample: int = SAMPLE) -> Index:
    """The index of ``rows`` as :func:`usable` gives them, for searches of up to ``k`` neighbours."""
    spark = rows.sparkSession
    same = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id", "row")
    merged = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy")
    first = rows.select(F.size("vector").alias("n")).head()
    dims = first["n"] if first else 1
    most = max(1, min(sample, SAMPLE_BYTES // (8 * dims)))
    chosen = rows.orderBy(F.xxhash64("row"), "row").limit(most).select("vector").toArrow()
    rotation = learned_rotation(_matrix(chosen["vector"])) if first else np.eye(1)
    total = rows.count()
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))
    blocks = max(-(-total // size), min(2 * spark.sparkContext.defaultParallelism, -(-total // LEAST_BLOCK)), 1)

    def encode(batches):
        for b in batches:
            if b.num_rows:
                code = np.packbits(_matrix(b["vector"]) @ rotation >= 0, axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary())], [*b.schema.names, "code"])

    kind = merged.schema["vector"].dataType.simpleString()
    coded = merged.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).mapInArrow(
        encode, f"row long, vec_id long, vector {kind}, block int, code binary"
    )
    return Index(written(coded, "codes"), rotation, blocks, total)


def allowed_errors(radius: int, substrings: int) -> list[int]:
    """Errors allowed in each substring (-1: not probed) so that one is met by any code within ``radius``."""
    least, more = divmod(radius + 1, substrings)
    return [least - 1 + (j < more) for j in range(substrings)]


class Buckets:
    """The substring tables of the codes of one block."""

    def __init__(self, codes: np.ndarray):
        self.words = _words(codes)
        self.parts = np.ascontiguousarray(self.words).view(np.uint16)
        self.tables = []
        for j in range(self.parts.shape[1]):
            order = np.argsort(self.parts[:, j], kind="stable")
            values, first, counts = np.unique(self.parts[order, j], return_index=True, return_counts=True)
            slot = np.full(1 << WIDTH, -1, dtype=np.int64)
            slot[values] = np.arange(len(values))
            self.tables.append((order, values, first, counts, slot))

    def within(self, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all codes at most ``radius`` bits from ``word``, and these distances."""
        part = np.ascontiguousarray(word).view(np.uint16)
        seen = np.zeros(len(self.words), dtype=bool)
        for j, errors in enumerate(allowed_errors(radius, len(part))):
            order, values, first, counts, slot = self.tables[j]
            if errors < 0:
                continue
            if errors < WIDTH and len(_MASKS[errors]) < len(values):
                hit = slot[part[j] ^ _MASKS[errors]]
                hit = hit[hit >= 0]
            else:  # fewer buckets than probes: the buckets themselves are tried
                hit = np.flatnonzero(np.bitwise_count(values ^ part[j]) <= errors)
            if len(hit):
                size = counts[hit]
                step = np.repeat(first[hit] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                seen[order[step + np.arange(size.sum())]] = True
        rows = np.flatnonzero(seen)
        far = np.bitwise_count(self.words[rows] ^ word).sum(axis=1)
        return rows[far <= radius], far[far <= radius]


_BITS = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint16))
#: For each number of errors, the substrings with at most so many bits.
_MASKS = [np.flatnonzero(_BITS <= t).astype(np.uint16) for t in range(WIDTH)]


def _words(codes: np.ndarray) -> np.ndarray:
    """Codes of any number of bytes as 64-bit words; what is filled up is equal everywhere."""
    return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)


def _search(index: Index, queries: DataFrame, k: int, radius: int | None) -> DataFrame:
    """The ``k`` best of each query and block within ``radius``; without one all rows are scanned."""
    rotation = index.rotation
    total = queries.count()
    size = max(1, min(GROUP, BLOCK_BYTES // (8 * len(rotation))))
    groups = -(-total // size)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return pa.Table.from_pylist([], schema)
        x, q = _matrix(rows["vector"]), _matrix(asked["vector"])
        norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        ids, row = rows["vec_id"].to_numpy(), rows["row"].to_numpy()
        q_ids, q_row = asked["vec_id"].to_numpy(), asked["row"].to_numpy()
        buckets = Buckets(np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(rows), -1))
        words = _words(np.packbits(q @ rotation >= 0, axis=1))
        out = []
        for n in range(len(q)):
            if radius is None:
                at = np.arange(len(x))
                far = np.bitwise_count(buckets.words ^ words[n]).sum(axis=1)
            else:
                at, far = buckets.within(words[n], radius)
            other = row[at] != q_row[n]
            at, far = at[other], far[other]
            if len(at) > k:
                near = (x[at] @ q[n]) / norm[at]
                bound = np.partition(near, len(at) - k)[len(at) - k]
                close = near >= bound - 1e-9 * q_norm[n]
                at, far = at[close], far[close]
            score = (x[at] * q[n]).sum(axis=1) / (norm[at] * q_norm[n])
            best = np.lexsort((row[at], ids[at], -score))[:k]
            out.append((np.full(len(best), q_row[n]), np.full(len(best), q_ids[n]), row[at][best], ids[at][best], score[best], far[best]))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=schema.names).cast(schema)

    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in FOUND.split(", ")])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    asked = queries.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(max(groups, 1))).cast("int")).withColumn("block", every(index.blocks))
    held = index.table.withColumn("group", every(groups))
    return held.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query over all blocks, with ``rank``."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def measured_radius(index: Index, queries: DataFrame, k: int, recall: float, pilots: int = PILOTS) -> int:
    """The Hamming distance within which ``recall`` of the true neighbours of the pilots lie."""
    some = written(queries.orderBy(F.xxhash64("row", F.lit(1)), "row").limit(pilots), "pilots")
    far = sorted(r["bits"] for r in _best(_search(index, some, k, None), k).select("bits").collect())  # pilots * k rows
    return far[min(len(far) - 1, int(recall * len(far)))] if far else 0


def search(index: Index, queries: DataFrame, k: int = 5, recall: float = 0.98) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each query row (row, vec_id, vector)."""
    queries = written(queries.select("row", "vec_id", "vector"), "queries")
    radius = measured_radius(index, queries, k, recall)
    bits, need = len(index.rotation), min(k, index.rows - 1)
    parts: list[DataFrame] = []
    todo = queries
    while True:
        best = written(_best(_search(index, todo, k, radius), k), "found")
        whole = best.where(F.col("rank") == need).select("query_row") if need else best.select("query_row")
        parts.append(best.join(whole, "query_row", "left_semi"))
        todo = written(todo.join(whole.withColumnRenamed("query_row", "row"), "row", "left_anti"), "queries")
        if radius >= bits or todo.isEmpty():
            break
        radius = min(bits, 2 * max(radius, 1))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return search(build(rows, 5), rows.where(F.col("vec_id") % 50 == 0), 5)
