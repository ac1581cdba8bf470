"""What one operator leaves in a Python worker goes when another one starts there."""

from __future__ import annotations

from pyspark.sql import functions as F

from reconcile.llm import best_fit, string_kernel, worker


def test_another_operator_drops_what_is_left(monkeypatch):
    monkeypatch.setattr(worker._Owner, "name", None)
    monkeypatch.setattr(worker._Owner, "drop", None)
    dropped = []
    worker.enter("a", lambda: dropped.append("a"))
    worker.enter("a", lambda: dropped.append("again"))
    assert not dropped
    worker.enter("b")
    worker.enter("a")
    assert dropped == ["a"]


def test_language_id_forgets_the_tokenizer(spark):
    docs = spark.createDataFrame([(i, f"some words here {i}", None) for i in range(40)], "doc_id long, text string, lang string")
    docs = docs.repartition(1).persist()
    assert best_fit.pack_documents(docs).count() == 40

    @F.pandas_udf("long")
    def encoders(ids):
        return ids * 0 + best_fit.encoder.cache_info().currsize

    string_kernel.drop_unidentified(docs).count()
    held = docs.select(encoders("doc_id").alias("n")).agg(F.max("n")).first()[0]
    docs.unpersist()
    assert held == 0
