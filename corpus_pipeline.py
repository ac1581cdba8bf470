"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reconcile.llm import best_fit, hamming_join, mixing, stream_dedup, string_kernel
from reconcile.session import work_path


def _bounded(spark: SparkSession) -> None:
    """Whole texts are read and go to Python workers in batches of a few megabytes, unless the
    cluster says otherwise; a worker then holds little besides its model."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", "4m"), ("spark.sql.parquet.columnarReaderBatchSize", "1024")):
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, value)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (no text, no letters) go."""
    _bounded(spark)
    return string_kernel.drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return stream_dedup.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8)."""
    _bounded(spark)
    return hamming_join.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; a source short of its share repeats for an epoch."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences."""
    _bounded(spark)
    return best_fit.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("source mixing", mix_sources),
    ("packing", pack),
]

#: Language scores, packing and state have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
