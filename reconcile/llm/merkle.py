"""A Merkle manifest of a corpus that grows by aligned appends.

Every document is a leaf. Per source the leaves stand by doc_id and each run of
three consecutive nodes hashes into one node of the next level until one remains,
the subroot; the subroots, by source, form a tree of the same kind above. A
document's witness is the list of its siblings up to the root.

``append`` adds documents to a manifest in a folder. Leaves are dealt into aligned
blocks of ``3 ** LEVELS``; a task streams the leaves of a block into open subtrees.
While a subtree is open its leaves hold a partial witness; when a run of siblings is
complete, every leaf below it gets the digests of the others. A full block is
closed: its rows are written once and later appends don't read them. The block
roots are then appended to a tree above in the same way, and so on, so that no task
sees more than a block. ``proofs`` extends each partial witness by the one of its
block.

A batch of an append counts once its ``heads`` are written, which happens last; an append
that stopped earlier leaves no trace in the manifest and can be repeated.

Scale: texts are read once and never shuffled. Positions come from a range
sort (source, doc_id) with counts per range, so a source that holds a third of all rows
is numbered by many tasks. There are as many rounds as the largest source has
levels divided by ``LEVELS``. The driver sees the largest leaf count only.

Defined cases: a null text, source, language, id or length hashes as ``-``. The null
source comes first; null ids come first in their source. Equal ids stand by leaf digest,
so repeated rows are leaves of their own with a defined root. An append whose ids don't
follow those already in the manifest is refused. A source with one document has its
leaf as subroot; with one source the subroot is the root; no sibling at all gives an
empty witness. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconcile.session import work_path

from .components import written

FAN = 3
#: Levels of one block: a task holds the witnesses of 3 ** 7 leaves at a time.
LEVELS = 7
#: Rows of one Arrow batch that a task returns, at least.
BATCH = 4096
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(text: Column | None = None) -> Column:
    """The digest of a row, optionally with another text."""

    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    columns = [F.col(c) for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return F.sha2(F.concat(*map(part, columns)).cast("binary"), 256)


def depth(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class OpenSubtrees:
    """The subtrees of one block while its leaves arrive in order."""

    def __init__(self):
        self.levels: list[list[tuple[str, list[int]]]] = [[]]
        self.witnesses: list[bytes] = []

    def append(self, digest: str) -> None:
        self.witnesses.append(b"")
        self._place(0, digest, [len(self.witnesses) - 1])

    def _place(self, level: int, digest: str, leaves: list[int]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append((digest, leaves))
        if len(self.levels[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The open run of a level becomes a node; its leaves learn their new siblings."""
        run, self.levels[level] = self.levels[level], []
        for k, (_, leaves) in enumerate(run):
            others = bytes.fromhex("".join(d for j, (d, _) in enumerate(run) if j != k))
            for i in leaves:
                self.witnesses[i] += others
        self._place(level + 1, node([d for d, _ in run]), [i for _, leaves in run for i in leaves])

    def close(self, levels: int) -> str:
        """Completes what is open up to ``levels``; the digest there."""
        for level in range(levels):
            if self.levels[level]:
                self._complete(level)
        return self.levels[levels][0][0]


def folded(digest: str, witness: bytes, *places: tuple[int, int]) -> str:
    """The root recomputed from a leaf, its siblings and its (index, nodes) in each tree upwards."""
    at = 0
    for index, nodes in places:
        while nodes > 1:
            others = min(FAN, nodes - index // FAN * FAN) - 1
            run = [witness[at + 32 * j : at + 32 * j + 32].hex() for j in range(others)]
            run.insert(index % FAN, digest)
            digest = node(run)
            at, index, nodes = at + 32 * others, index // FAN, -(-nodes // FAN)
    return digest


def _numbered(items: DataFrame, order: list[str]) -> DataFrame:
    """``items`` with ``idx``, the position from 0 within ``key`` by ``order``."""
    ranged = written(
        items.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)),
        "merkle-ranged",
    )
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ranged.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    )
    return (
        ranged.join(parts.select("key", "part", "first", "before"), ["key", "part"])
        .withColumn("idx", F.col("at") - F.col("first") + F.col("before"))
        .drop("at", "part", "first", "before")
    )


def _grown(items: DataFrame, levels: int) -> DataFrame:
    """``items`` (key, idx, total, digest, more) with block, witness and, on a block's first row, block_root."""

    def run(batches):
        ready: list[pa.Table] = []
        held: list[pa.RecordBatch] = []
        current, subtrees = None, None

        def finish() -> pa.Table:
            rows = pa.Table.from_batches(held)
            root = subtrees.close(min(levels, depth(held[0]["total"][0].as_py())))
            return rows.append_column("witness", pa.array(subtrees.witnesses, pa.binary())).append_column(
                "block_root", pa.array([root] + [None] * (len(rows) - 1), pa.string())
            )

        for b in batches:
            keys = list(zip(b["key"].to_pylist(), b["block"].to_pylist()))
            digests = b["digest"].to_pylist()
            at = 0
            while at < len(keys):
                if keys[at] != current:
                    if held:
                        ready.append(finish())
                    current, subtrees, held = keys[at], OpenSubtrees(), []
                    if sum(map(len, ready)) >= BATCH:
                        yield from pa.concat_tables(ready).combine_chunks().to_batches()
                        ready = []
                end = at
                while end < len(keys) and keys[end] == current:
                    subtrees.append(digests[end])
                    end += 1
                held.append(b.slice(at, end - at))
                at = end
        if held:
            ready.append(finish())
            yield from pa.concat_tables(ready).combine_chunks().to_batches()

    dealt = (
        items.withColumn("block", F.expr(f"idx div {FAN**levels}"))
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", "idx")
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(run, f"{fields}, witness binary, block_root string")


def _above(grown: DataFrame, levels: int) -> DataFrame:
    """key, block, upper, root: the witness of each block in the tree of its key."""
    roots = grown.where("block_root is not null").select(
        "key", "block", F.col("block_root").alias("digest"), F.ceil(F.col("total") / FAN**levels).alias("total")
    )
    most = roots.agg(F.max("total")).head()[0] or 0
    if most <= 1:
        return roots.select("key", "block", F.lit(b"").alias("upper"), F.col("digest").alias("root"))
    next_ = written(_grown(roots.withColumnRenamed("block", "idx"), levels), "merkle-blocks")
    return next_.join(_above(next_, levels), ["key", "block"]).select(
        "key", F.col("idx").alias("block"), F.concat("witness", "upper").alias("upper"), "root"
    )


def _latest(spark: SparkSession, path: str) -> int | None:
    """Number of the last complete append, None for a new manifest."""
    try:
        return spark.read.parquet(f"{path}/heads").agg(F.max("batch")).head()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append(docs: DataFrame, path: str, tampered: Column | None = None, levels: int = LEVELS) -> None:
    """Add ``docs`` to the manifest at ``path``, a shared folder that only appends write to.

    ``docs`` needs doc_id, source, lang, n_chars and text. ``tampered`` is another
    text to check each witness with; null or absent means the text itself.
    """
    spark = docs.sparkSession
    last = _latest(spark, path)
    batch = 0 if last is None else last + 1
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull() & (tampered != F.col("text")), leaf(tampered))
    leaves = docs.select(
        F.concat(F.lit("s"), F.col("source").cast("string")).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), other.alias("other"),
    ).withColumn("key", F.coalesce("key", F.lit("")))
    new = _numbered(written(leaves, "merkle-leaves"), ["doc_id", "digest"])
    heads = new.groupBy("key").agg(F.count(F.lit(1)).alias("added"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    items = new
    if last is None:
        heads = heads.select("key", F.col("added").alias("total"), "high", F.lit(0).cast("long").alias("old"))
    else:
        before = _heads(spark, path, last).select("key", F.col("total").alias("old"), F.col("high").alias("old_high"))
        heads = heads.join(before, "key", "full")
        if not heads.where("added is not null and old is not null and (unnamed or low <= old_high)").isEmpty():
            raise ValueError("appended ids must follow those in the manifest of their source")
        heads = heads.select(
            "key", (F.coalesce("added", F.lit(0)) + F.coalesce("old", F.lit(0))).alias("total"),
            F.coalesce("high", "old_high").alias("high"), F.coalesce("old", F.lit(0)).alias("old"),
        )
        still_open = spark.read.parquet(f"{path}/rows/state=open/batch={last}")
        items = new.join(heads.select("key", "old"), "key").withColumn("idx", F.col("idx") + F.col("old")).drop("old")
        items = items.unionByName(still_open.select(*items.columns))
    heads = written(heads, "merkle-heads")
    items = items.join(heads.select("key", "total"), "key")
    grown = written(_grown(items, levels), "merkle-grown")
    closed = (F.col("block") + 1) * FAN**levels <= F.col("total")
    rows = grown.drop("total")
    rows.where(closed).write.mode("overwrite").parquet(f"{path}/rows/state=closed/batch={batch}")
    rows.where(~closed).write.mode("overwrite").parquet(f"{path}/rows/state=open/batch={batch}")
    done = spark.range(1).select(F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("high"))
    heads.select("key", "total", "high").union(done).withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/heads")


def _heads(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """key, total, high after a batch; the row without key only marks the batch as complete."""
    return spark.read.parquet(f"{path}/heads").where((F.col("batch") == batch) & F.col("key").isNotNull())


def proofs(spark: SparkSession, path: str, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, leaf, subroot, root, witness (digests, 32 bytes each), folded_root, verified.

    ``folded_root`` is recomputed from the tampered leaf, where the append gave one,
    and the siblings; ``verified`` says whether it is the root.
    """
    last = _latest(spark, path)
    heads = _heads(spark, path, last).select("key", "total")
    closed = spark.read.parquet(*[f"{path}/rows/state=closed/batch={n}" for n in range(last + 1)])
    rows = closed.unionByName(spark.read.parquet(f"{path}/rows/state=open/batch={last}"))
    blocks = rows.where("block_root is not null").join(heads, "key")
    uppers = written(_above(blocks, levels), "merkle-above")

    sources = uppers.where("block = 0").select(F.lit("").alias("key"), F.col("key").alias("source_key"), F.col("root").alias("digest"))
    sources = _numbered(sources, ["source_key"]).withColumn("total", F.lit(heads.count()).cast("long"))
    tops = written(_grown(sources, levels), "merkle-sources")
    tops = tops.join(_above(tops, levels).withColumnRenamed("root", "top"), ["key", "block"]).select(
        F.col("source_key").alias("key"), F.col("idx").alias("place"), F.col("total").alias("places"),
        F.concat("witness", "upper").alias("top_witness"), "top",
    )
    uppers = uppers.join(tops, "key").join(heads, "key").select(
        "key", "block", F.concat("upper", "top_witness").alias("upper"), F.col("root").alias("subroot"), F.col("top").alias("root"), "total", "place", "places"
    )

    @F.pandas_udf("string")
    def refold(leaf: pd.Series, witness: pd.Series, idx: pd.Series, total: pd.Series, place: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([folded(d, w, (i, n), (j, m)) for d, w, i, n, j, m in zip(leaf, witness, idx, total, place, places)], dtype=object)

    joined = rows.drop("block_root").join(uppers, ["key", "block"]).withColumn("witness", F.concat("witness", "upper"))
    again = refold(F.coalesce("other", "digest"), "witness", "idx", "total", "place", "places")
    return joined.withColumn("folded_root", again).select(
        "doc_id", F.when(F.col("key") != "", F.substr("key", F.lit(2))).alias("source"), F.col("digest").alias("leaf"),
        "subroot", "root", "witness", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    path = work_path(spark, "merkle")
    append(docs, path, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))))
    return proofs(spark, path).select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.lower(F.hex("witness")).cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified",
    )


#: CRC-32 bit by bit, then the levels of both trees as recursive tables.
ORACLE = """
with recursive d as (
  select doc_id, source, text, concat(
    coalesce(concat(strlen(cast(doc_id as varchar)), ':', cast(doc_id as varchar)), '-'),
    coalesce(concat(strlen(source), ':', source), '-'),
    coalesce(concat(strlen(lang), ':', lang), '-'),
    coalesce(concat(strlen(cast(n_chars as varchar)), ':', cast(n_chars as varchar)), '-')) as front,
    list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
      lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, i: xor(b >> 1, 3988292384::bigint * (b & 1)))) as crc
  from documents),
l as (
  select *, sha256(concat(front, coalesce(concat(strlen(text), ':', text), '-'))) as leaf,
    case when crc % 2 = 1 and text is not null
      then sha256(concat(front, strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')))
      else sha256(concat(front, coalesce(concat(strlen(text), ':', text), '-'))) end as start
  from d),
t as (
  select 0 as level, source, row_number() over (partition by source order by doc_id) - 1 as idx,
    leaf as digest, count(*) over (partition by source) as n from l
  union all
  select level, source, idx, digest, n from (
    select level + 1 as level, source, idx // 3 as idx, sha256(string_agg(digest, '' order by idx)) as digest, (n + 2) // 3 as n
    from t where n > 1 group by level, source, idx // 3, n)),
s as (
  select 0 as level, row_number() over (order by source nulls first) - 1 as idx, source, digest, count(*) over () as n
  from t where n = 1
  union all
  select level, idx, null, digest, n from (
    select level + 1 as level, idx // 3 as idx, sha256(string_agg(digest, '' order by idx)) as digest, (n + 2) // 3 as n
    from s where n > 1 group by level, idx // 3, n)),
w as (
  select 0 as level, 0 as tree, source, doc_id, leaf, start as folded, '' as proof, leaf as own,
    row_number() over (partition by source order by doc_id) - 1 as idx, count(*) over (partition by source) as n
  from l
  union all
  select case when up then level + 1 else 0 end, case when up then tree else 1 end, source, doc_id, leaf,
    case when up then sha256(list_aggregate(list_transform(run, lambda x, i: case when i = idx % 3 + 1 then folded else x end), 'string_agg', '')) else folded end,
    case when up then concat(proof, list_aggregate(list_filter(run, lambda x, i: i <> idx % 3 + 1), 'string_agg', '')) else proof end,
    leaf, case when up then idx // 3 else place end, case when up then (n + 2) // 3 else places end
  from (
    select w.*, w.n > 1 as up, b.run, p.idx as place, p.n as places
    from w left join (
      select 0 as tree, source, level, idx // 3 as at, list(digest order by idx) as run from t group by source, level, idx // 3
      union all select 1, null, level, idx // 3, list(digest order by idx) from s group by level, idx // 3) b
      on w.n > 1 and b.tree = w.tree and b.level = w.level and b.at = w.idx // 3 and (w.tree = 1 or b.source is not distinct from w.source)
    left join s p on p.level = 0 and p.source is not distinct from w.source
    where w.tree = 0 or w.n > 1)),
e as (select * from w where tree = 1 and n = 1)
select e.doc_id, e.leaf, t.digest as subroot, r.digest as root, sha256(proof) as proof_sha256, folded as folded_root, folded = r.digest as verified
from e join t on t.n = 1 and t.source is not distinct from e.source
join (select digest from s where n = 1) r on true
"""
