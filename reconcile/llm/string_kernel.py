"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the cosine of their presence vectors over character
n-grams of 1 to ``LONGEST`` letters, hashed to ``SLOTS`` slots. ``LANDMARKS``
landmark texts per language span the Nyström approximation, and one-versus-rest
kernel ridge regression on it gives one column of weights per language. Scoring
is two matrix products per batch of texts.

Training reads a bounded sample: of each language the ``PER_LANGUAGE`` labelled ids
with the smallest hash, one text each, for at most ``LANGUAGES`` languages, those with the
most labelled rows. The driver so holds at most ``PER_LANGUAGE * LANGUAGES`` rows of
packed presence bits (``SLOTS`` / 8 bytes each), a few megabytes for a handful of
languages. Prediction covers every row and whole texts, without a shuffle.

Defined cases: null text and text without letters give ``und`` with score 0, as
does every text when nothing was learned; rows without doc_id aren't learned
from and aren't held out. Where rows repeat an id and a language, the smallest
text stands for them in the sample. An empty table gives no rows; lang, source and doc_id
are never inputs of a prediction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import worker
from .components import free

LONGEST, SLOTS = 3, 1 << 14
PER_LANGUAGE, LANDMARKS = 400, 32
#: Languages learned at most; labels beyond the most frequent ones aren't learned.
LANGUAGES = 200
RIDGE, SHARPNESS, BATCH = 0.01, 5.0, 128
UNKNOWN = "und"

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SHIFT = np.uint64(64 - SLOTS.bit_length() + 1)


def letters(text: str | None) -> np.ndarray | None:
    """Lower-case code points with every run of other characters as one space; None without letters."""
    if not text or not any(map(str.isalpha, text)):
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    other = np.where(c < 0x80, (c < 97) | (c > 122), (c < 0xC0) & (c != 0xAA) & (c != 0xB5) & (c != 0xBA) | (c == 0xD7) | (c == 0xF7) | ((c >= 0x2000) & (c < 0x2070)))
    c = np.where(other, np.uint32(32), c)
    return np.concatenate(([np.uint32(32)], c[~(other & np.concatenate(([True], other[:-1])))])).astype(np.uint64)


def presence(c: np.ndarray, row: np.ndarray) -> None:
    """Mark the n-grams of ``c`` in ``row``."""
    code = np.zeros(len(c), np.uint64)
    for n in range(min(LONGEST, len(c))):
        code = (code[: len(c) - n] ^ (c[n:] * _ODD[n])) * _ODD[0]
        row[(code >> _SHIFT).astype(np.intp)] = 1


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Landmarks and weights; ``languages`` is empty when nothing was learned."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    @staticmethod
    def fit(bits: np.ndarray, labels: list[str], per_language: int = LANDMARKS) -> Model:
        """``bits``: one row of packed presence bits per text; unpacked ``BATCH`` rows at a time."""
        languages = sorted(set(labels))
        y = np.array([languages.index(v) for v in labels])
        if not languages:
            return Model([], np.zeros((SLOTS, 0), np.float32), np.zeros((0, 0), np.float32))

        def unit(packed: np.ndarray) -> np.ndarray:
            x = np.unpackbits(packed, axis=1).astype(np.float64)
            x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
            return x

        marks = unit(bits[np.concatenate([np.flatnonzero(y == k)[:per_language] for k in range(len(languages))])])
        values, vectors = np.linalg.eigh(marks @ marks.T)
        keep = values > 1e-6 * values.max()
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        kernel = np.vstack([unit(bits[at : at + BATCH]) @ marks.T for at in range(0, len(bits), BATCH)])
        phi = np.hstack((kernel @ whiten, np.ones((len(bits), 1))))
        target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
        share = 1 / np.bincount(y)[y]  # each language weighs the same
        w = np.linalg.solve((phi * share[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1]) / len(phi), (phi * share[:, None]).T @ target)
        bias = w[-1:]
        return Model(languages, marks.T.astype(np.float32), np.vstack((whiten @ w[:-1], bias)).astype(np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return out, score
        for at in range(0, len(texts), BATCH):
            found = [(i, c) for i in range(at, min(at + BATCH, len(texts))) if (c := letters(texts[i])) is not None]
            if not found:
                continue
            x = np.zeros((len(found), SLOTS), np.float32)
            for k, (_, c) in enumerate(found):
                presence(c, x[k])
            kernel = x @ self.landmarks / np.sqrt(x.sum(axis=1, keepdims=True))
            margin = SHARPNESS * (kernel @ self.weights[:-1] + self.weights[-1:])
            p = np.exp(margin - margin.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for k, (i, _) in enumerate(found):
                out[i], score[i] = self.languages[p[k].argmax()], p[k].max()
        return out, score


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Fit on the labelled rows (lang not null) that aren't held out."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = base.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = usable.groupBy("lang", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    most = ids.groupBy("lang").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.where(F.col("lang").isin([r["lang"] for r in most])).withColumn("place", F.row_number().over(order))
    chosen = chosen.where(F.col("place") <= per_language).select("doc_id", "lang")
    # One text for each chosen id. The chosen ids are at most per_language * languages
    # pairs, so they go to the texts, which stay where they lie.
    texts = usable.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def bits(batches):
        worker.enter("language")
        for b in batches:
            rows = []
            for lang, text in zip(b["lang"], b["text"]):
                if (c := letters(text)) is not None:
                    presence(c, row := np.zeros(SLOTS, np.uint8))
                    rows.append((lang, np.packbits(row).tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "bits"])

    # bounded: per_language rows for each of the languages
    rows = texts.select("lang", "text").mapInPandas(bits, "lang string, bits binary").collect()
    rows = sorted((r["lang"], bytes(r["bits"])) for r in rows)
    packed = np.array([np.frombuffer(b, np.uint8) for _, b in rows], np.uint8).reshape(len(rows), SLOTS // 8)
    return Model.fit(packed, [lang for lang, _ in rows])


def classify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""

    def run(batches):
        worker.enter("language")
        for b in batches:
            lang, score = model.predict(list(b["text"]))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "lang_pred": lang, "score": score})

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return base.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return classify(docs, train(docs))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` without null texts and texts without letters, all columns kept, without a shuffle.

    A null ``lang`` gets the predicted language; it stays null where nothing was learned.
    """
    model = train(docs)

    @F.pandas_udf("string")
    def language(text: pd.Series) -> pd.Series:
        worker.enter("language")
        if not model.languages:
            return pd.Series([None if letters(t) is None else "" for t in text], dtype=object)
        return pd.Series([lang if score > 0 else None for lang, score in zip(*model.predict(list(text)))], dtype=object)

    # as if it were not deterministic, so that the filter and the column share one call
    name = free(docs, "__lang")
    found = docs.withColumn(name, language.asNondeterministic()(F.col("text").cast("string"))).where(F.col(name).isNotNull())
    lang = F.coalesce("lang", F.nullif(F.col(name), F.lit("")).cast(docs.schema["lang"].dataType))
    return found.withColumn("lang", lang).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
