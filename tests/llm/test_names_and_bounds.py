"""Extra columns named like internal ones, and the bound of the language sample."""

import pytest
from pyspark.sql import functions as F

from reconcile.llm import hamming_join, mixing, stream_dedup, string_kernel, unit_dedup
from reconcile.llm.components import free

CLASH = ["__row", "__ROW_", "__key", "__epoch", "__id", "__digest", "__lang", "row", "key", "node", "digest", "best", "removed_"]
TEXT = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture
def clashing(spark):
    rows = [(i, TEXT if i < 4 else f"{TEXT} {i} other words here {i * 7}", "en", "src1", 0) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(1) for c in CLASH if c.lower() not in ("__row_",)}).withColumn("__row_", F.lit(1))


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, A_ int")
    assert free(df, "b") == "b" and free(df, "a") == "a__"


def test_clashing_names_change_nothing(spark, clashing):
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    near = hamming_join.near_groups(clashing, words=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near) == sorted(
        (r.doc_id, r.component_id, r.kept) for r in hamming_join.near_groups(plain, words=2).collect()
    )
    assert sum(r.kept for r in near if r.doc_id < 4) == 1
    found = unit_dedup.repeats(clashing).collect()
    assert found and {r.doc_id for r in found if r.start == 0 and r.end == len(TEXT)} == {1, 2, 3}
    for keep in (hamming_join.drop_near, stream_dedup.drop_exact, mixing.mix, string_kernel.drop_unidentified, unit_dedup.without_repeats):
        out, base = keep(clashing), keep(plain)
        assert [c for c in out.columns if c in clashing.columns] == clashing.columns, keep
        assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in base.collect()), keep
        ones = [c for c in clashing.columns if c not in plain.columns]
        assert all(r[c] == 1 for r in out.collect() for c in ones), keep


def test_repeated_ids_and_dirty_labels_stay_within_the_sample(spark, monkeypatch):
    seen = []
    fit = string_kernel.Model.fit
    monkeypatch.setattr(string_kernel.Model, "fit", staticmethod(lambda bits, labels, *a: (seen.append(len(labels)), fit(bits, labels, *a))[1]))
    hot = [(4, f"hello there friend number {i}", "en") for i in range(2000)]
    rest = [(i, f"guten tag lieber freund {i}", "de") for i in range(3000) if i % 3]
    dirty = [(10_000 + i, "some text", f"label{i}") for i in range(60)]
    docs = spark.createDataFrame(hot + rest + dirty, "doc_id long, text string, lang string")
    model = string_kernel.train(docs, per_language=50, languages=20)
    assert len(model.languages) <= 20 and {"en", "de"} <= set(model.languages)
    assert seen[0] <= 50 + 1 + 20
    # the same sample whatever the order of the rows
    again = string_kernel.train(docs.repartition(7), per_language=50, languages=20)
    assert again.languages == model.languages and (again.weights == model.weights).all()


def test_next_document_of_ids_that_span_bigint(spark):
    from reconcile.llm import syncmers

    ids = [-(2**63), -5, 0, 1, 2, 3, 4, 5, 6, 7, 2**60, 2**63 - 1]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in syncmers.with_next(docs, ["doc_id", "text"], range_rows=2).collect()}
    assert got == {i: f"t{n}" for i, n in zip(ids, ids[1:] + ids[:1])}
    two = docs.where(F.col("doc_id").isin(-(2**63), 2**63 - 1))
    got = {r.doc_id: r.next_text for r in syncmers.with_next(two, ["doc_id", "text"]).collect()}
    assert got == {-(2**63): f"t{2**63 - 1}", 2**63 - 1: f"t{-(2**63)}"}
