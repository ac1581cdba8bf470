"""Exact deduplication by a stateful stream over digests.

Every document becomes one small record (digest of the normalised text, id,
length, row locator) in a table below the shared folder. A stream reads that
table file by file into RocksDB state keyed by digest. The state never expires
and holds, per digest, how often it was seen and which record stays. The state
is then read back as a table, and every group with more than one record is
checked on its full bytes against the text that stays.

Scale: only records travel through the stream and its partial aggregation sends
one row per digest and task, so a third of all rows in one group is one key with
a few rows. Full texts are shuffled once, for the byte check; the joins are
plain equi joins whose hot keys the adaptive planner splits.

Defined cases: null text counts as empty, and empty texts form one group. Of
equal texts the longest original stays, then the smallest doc_id (null last),
then the first row of the table, so repeated rows leave exactly one. Texts with
equal digests and different bytes form groups of their own. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconcile.session import work_path

from .components import free

#: State on disk; without preallocation, which costs 4 MB for each small store.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _texts(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body"), F.char_length(text).cast("long").alias("n_chars"))
        .withColumn("digest", digest(F.col("body")))
    )


def keyed_state(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """Stream the records at ``path`` into keyed state; the state as a table.

    One row per digest: digest, group_size, and ``best``, the record that stays.
    """
    checkpoint = work_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = (
            spark.readStream.schema(spark.read.parquet(path).schema)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(path)
        )
        # bitwise not turns "smallest first" into "largest first" without overflow
        best = F.struct("n_chars", F.bitwise_not(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("rank"), F.bitwise_not("row_id").alias("seen"), "doc_id", "row_id")
        query = (
            stream.groupBy("digest")
            .agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    best, size = state.schema["value"].dataType.names
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col("value")[size].alias("group_size"),
        F.col("value")[best].alias("best"),
    )


def exact_groups(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 10_000,
) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept.

    ``docs`` needs doc_id and text. ``files_per_batch`` bounds one micro-batch.
    """
    spark = docs.sparkSession
    texts = _texts(docs, digest)
    path = work_path(spark, "dedup-records")
    texts.select("digest", "doc_id", "n_chars", F.monotonically_increasing_id().alias("row_id")).write.parquet(path)
    records = spark.read.parquet(path)
    if records.isEmpty():
        index = records.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("n_chars", "doc_id", "row_id")).alias("best"))
    else:
        index = keyed_state(spark, path, files_per_batch)
    index_path = work_path(spark, "dedup-index")
    index.select(
        "digest", "group_size", F.col("best.doc_id").alias("keep_id"),
        F.col("best.n_chars").alias("keep_chars"), F.col("best.row_id").alias("keep_row"),
    ).write.parquet(index_path)
    index = spark.read.parquet(index_path)

    other = _other_bytes(texts, index)
    apart = other.groupBy("digest", "body").agg(
        F.max(F.struct("n_chars", F.bitwise_not(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("rank"), "doc_id")).alias("own"),
        F.count(F.lit(1)).alias("own_size"),
    )
    apart_docs = (
        other.select("digest", "doc_id", "n_chars", "body")
        .distinct()
        .join(apart, ["digest", "body"])
        .select("digest", "doc_id", "n_chars", F.col("own.doc_id").alias("own_id"), "own_size")
    )
    lost = other.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    own = F.col("own_size").isNotNull()
    return (
        records.join(index, "digest")
        .join(lost, "digest", "left")
        .join(
            apart_docs.withColumnsRenamed({"digest": "d2", "doc_id": "i2", "n_chars": "c2"}),
            (F.col("digest") == F.col("d2")) & F.col("doc_id").eqNullSafe(F.col("i2")) & (F.col("n_chars") == F.col("c2")),
            "left",
        )
        .select(
            "doc_id",
            "digest",
            F.when(own, F.col("own_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(own, F.col("own_size")).otherwise(F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"),
            F.when(own, F.col("doc_id").eqNullSafe(F.col("own_id"))).otherwise(F.col("row_id") == F.col("keep_row")).alias("kept"),
        )
    )


def _other_bytes(texts: DataFrame, index: DataFrame) -> DataFrame:
    """Documents whose bytes differ from the text that stays under their digest.

    Written below the shared folder; empty unless digests collide.
    """
    spark = texts.sparkSession
    hits_path, other_path = work_path(spark, "dedup-hits"), work_path(spark, "dedup-other")
    groups = index.where("group_size > 1").select("digest", "keep_id", "keep_chars")
    texts.join(groups, "digest").write.parquet(hits_path)
    hits = spark.read.parquet(hits_path)
    stays = (
        hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
        .groupBy("digest")
        .agg(F.max("body").alias("kept_body"))
    )
    (
        hits.join(stays, "digest")
        .where(F.col("body") != F.col("kept_body"))
        .select("digest", "doc_id", "n_chars", "body")
        .write.parquet(other_path)
    )
    return spark.read.parquet(other_path)


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of equal texts, all columns kept.

    Rows that repeat both doc_id and text leave one row.
    """
    name, digest = free(docs, "__id"), free(docs, "__digest")
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    kept = exact_groups(docs).where("kept").select(own.alias(name), F.col("digest").alias(digest))
    keyed = docs.withColumns({name: own, digest: sha256(normalised(F.col("text")))})
    return (
        keyed.join(kept, [name, digest], "left_semi")
        .dropDuplicates([name, digest])
        .drop(name, digest)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).withColumnRenamed("digest", "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
with t as (select doc_id, length(coalesce(text, '')) as n,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
r as (select doc_id, text_sha256, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
  count(*) over (partition by text_sha256) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from r
"""
