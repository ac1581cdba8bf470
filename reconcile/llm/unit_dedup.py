"""Substring deduplication: units of texts hashed, all but the earliest removed.

Units are of four levels: every line; every sentence, within its line and across
the line breaks of its paragraph; every paragraph, that is a run of lines without
an empty one between; and passages cut where a pair of tokens has the smallest
hash around it, which fall into step inside a repeated passage wherever it begins
and without any full stop. Units are normalised (lower case, one space between
words) and hashed to 128 bits; digests are grouped globally over all levels, the
occurrence with the smallest (doc_id, row, offset) stays and every other one is
reported with its offsets in the original text. Reported units may lie inside
each other.

Scale: one pass over the texts writes units below the shared folder; grouping
pre-aggregates per task, so a line in a third of all documents arrives as one row
a task, and the join back to its occurrences is an equi join the adaptive
planner splits. Texts are not shuffled.

Defined cases: null and empty texts have no units. Units of ``least`` words or
``LEAST_CHARS`` code points count, so that lines of unspaced scripts count as well,
and the sentences of a line also count joined until they have ``least`` words. With
``lines``, as in the query, lines and paragraphs of any length count besides, but no
short sentence inside a longer line, which says nothing about a copy. With ``short``
units of every level and any length count, each sentence by itself.
Passages have ``least`` tokens at least; in unspaced scripts each code point is a
token. A row without doc_id ranks last; rows that repeat a doc_id rank by their
place in the table. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import free, written

LEAST_WORDS, LEAST_CHARS = 8, 40
#: Row number of tables that are read more than once; made by the place in the table where it is missing.
ROW = "__row"
#: Documents whose units leave the Python worker together.
TOGETHER = 256
_PARAGRAPH = re.compile(r"[^\r\n]+(?:(?:\r\n|\r|\n)[^\S\r\n]*[^\s][^\r\n]*)*")
_LINE = re.compile(r"[^\r\n]+")
_STOPS = ".!?\u0589\u061f\u06d4\u0964\u0965\u1362\u3002\uff01\uff0e\uff1f\uff61"
_SENTENCE = re.compile(rf"[^{_STOPS}]*[{_STOPS}]*")
# Thai, Lao, Tibetan, Burmese, Khmer, kana and ideographs have no spaces between words
_TOKEN = re.compile(r"[^\s\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+|\S")


#: By code point: white space, and a token by itself.
_SPACE, _SINGLE = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
_SPACE[[c for c in range(0x110000) if chr(c).isspace()]] = True
for _first, _last in ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3000, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
    _SINGLE[_first : _last + 1] = True
#: Tokens whose codes one Python worker remembers; above it the memory starts anew.
REMEMBERED = 1 << 17


class _Codes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[token] = crc32(token.lower().encode("utf-8", "replace"))
        return code


_codes = _Codes()


def _unspaced(raw: np.ndarray) -> bool:
    """Whether any of the code points is a token by itself."""
    return bool(raw.max(initial=0) >= 0xE00 and _SINGLE[raw].any())


def _tokens(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The tokens of a text with their starts and ends."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if _unspaced(raw):
        spans = np.array([m.span() for m in _TOKEN.finditer(text)], np.int64).reshape(-1, 2)
        return _TOKEN.findall(text), spans[:, 0], spans[:, 1]
    space = np.concatenate(([True], _SPACE[raw], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    return text.split(), edge[::2], edge[1::2]


def _passages(code: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Token ranges between cuts; a cut is where a pair of tokens hashes lowest among ``least - 1`` on either side."""
    n = len(code) - 1
    if n < least:
        return []
    h = (code[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ code[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    reach = max(least - 1, 1)
    padded = np.full(n + 2 * reach, np.iinfo(np.uint64).max)
    padded[reach : reach + n] = h
    before, after = padded[:n].copy(), padded[reach + 1 : reach + 1 + n].copy()
    for j in range(1, reach):
        np.minimum(before, padded[j : j + n], out=before)
        np.minimum(after, padded[reach + 1 + j : reach + 1 + j + n], out=after)
    cuts = [0, *np.flatnonzero((h < before) & (h <= after)).tolist(), len(code)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b - a >= least]


def _within(first: np.ndarray, last: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts into which ``cuts`` cut the spans from ``first`` to ``last``; all ascend, spans lie apart."""
    at = np.searchsorted(first, cuts, "left") - 1
    inside = cuts[(at >= 0) & (cuts < last[at])]
    return np.sort(np.concatenate((first, inside))), np.sort(np.concatenate((last, inside)))


def _joined(ends: list[int], words: list[int], start: int, least: int) -> list[tuple[int, int]]:
    """Sentences of a line joined until they have ``least`` words; a short rest joins the unit before it."""
    own: list[tuple[int, int]] = []
    total, at = 0, start
    for end, n in zip(ends, words):
        total += n
        if total >= least:
            own.append((at, end))
            total, at = 0, end
    if total and own:
        own[-1] = (own[-1][0], ends[-1])
    return own


def _spans(matches) -> np.ndarray:
    return np.array([m.span() for m in matches], np.int64).reshape(-1, 2)


def _lower(text: str) -> str | None:
    """``text`` in lower case where every part of it is lower-cased like the whole and keeps its places; else None."""
    low = text.lower()
    return low if len(low) == len(text) and "\u03a3" not in text else None  # a capital sigma depends on what follows


def _units(text: str, least: int, short: bool, lines: bool) -> tuple[np.ndarray, list[str]]:
    """(start, end, words) of the units of a text, by start and end, and their normalised texts."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.concatenate(([True], _SPACE[raw], [True]))
    edge = np.flatnonzero(edge[1:] != edge[:-1])
    first, last = edge[::2], edge[1::2]  # of words
    if not len(first):
        return np.zeros((0, 3), np.int64), []
    lower = _lower(text)
    whole = None if lower is None else " ".join(lower.split())

    def reach(start, end):
        """Numbers of the first word that ends after ``start`` and of the last that starts before ``end``."""
        return np.searchsorted(last, start, "right"), np.searchsorted(first, end, "left") - 1

    paragraph, line = _spans(_PARAGRAPH.finditer(text)), _spans(_LINE.finditer(text))
    stops = np.array([m.end() for m in _SENTENCE.finditer(text)], np.int64)
    found = [paragraph, line, np.stack(_within(paragraph[:, 0], paragraph[:, 1], stops), axis=1)]
    start, end = _within(line[:, 0], line[:, 1], stops)
    found.append(np.stack((start, end), axis=1))
    if not short:  # else each of the joined sentences counts by itself
        low, high = reach(start, end)
        words, ends = (high - low + 1).tolist(), end.tolist()
        of = [*np.searchsorted(start, line[:, 0]).tolist(), len(start)]
        joined = [
            span for at, a, b in zip(line[:, 0].tolist(), of[:-1], of[1:]) if b - a > 1
            for span in _joined(ends[a:b], words[a:b], at, least)
        ]
        found.append(np.array(joined, np.int64).reshape(-1, 2))
    if whole is None or _unspaced(raw):
        tokens, starts, stopped = _tokens(text)
        code = np.fromiter(map(_codes.__getitem__, tokens), np.uint64, len(tokens))
    else:  # tokens are the words; most are met once, so their codes aren't looked up
        starts, stopped = first, last
        code = np.fromiter(map(crc32, whole.encode("utf-8", "replace").split(b" ")), np.uint64, len(first))
    for a, b in zip(*(np.searchsorted(starts, paragraph[:, k]).tolist() for k in (0, 1))):
        if b - a > least:
            cut = np.array(_passages(code[a:b], least), np.int64).reshape(-1, 2) + a
            found.append(np.stack((starts[cut[:, 0]], stopped[cut[:, 1] - 1]), axis=1))

    spans = np.concatenate(found)
    size = len(raw) + 1
    place = spans[:, 0] * size + spans[:, 1]
    any_length = np.full(len(spans), short)
    if lines:
        any_length |= np.isin(place, place[: len(paragraph) + len(line)])
    low, high = reach(spans[:, 0], spans[:, 1])
    kept = np.flatnonzero(low <= high)  # others are spaces alone
    low, high = low[kept], high[kept]
    start, end = np.maximum(spans[kept, 0], first[low]), np.minimum(spans[kept, 1], last[high])
    words = high - low + 1
    counted = np.flatnonzero(any_length[kept] | (end - start >= LEAST_CHARS) | (words >= least))
    # spans may differ in spaces around them
    one = counted[np.unique((start * size + end)[counted], return_index=True)[1]]
    start, end, words, low, high = (x[one] for x in (start, end, words, low, high))
    if whole is None:
        texts = [" ".join(text[a:b].lower().split()) for a, b in zip(start.tolist(), end.tolist())]
    else:
        at = np.cumsum(last - first + 1) - (last - first + 1)  # places of words in it
        cut = zip((at[low] + start - first[low]).tolist(), (at[high] + end - first[high]).tolist())
        texts = [whole[a:b] for a, b in cut]
    return np.stack((start, end, words), axis=1), texts


def units(
    text: str | None, least: int = LEAST_WORDS, short: bool = False, lines: bool = False
) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normalised) of the units of a text, by start and end."""
    places, texts = _units(text or "", least, short, lines)
    return [(*place, unit) for place, unit in zip(places.tolist(), texts)]


def unit_table(docs: DataFrame, least: int = LEAST_WORDS, short: bool = False, lines: bool = False) -> DataFrame:
    """doc_id, row, start, end, n_words and the digest (high, low) of every unit."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), TOGETHER):
                part, places, digests = b.iloc[at : at + TOGETHER], [], []
                for text in part["text"]:
                    place, own = _units(text or "", least, short, lines)
                    places.append(place)
                    digests += [blake2b(unit.encode("utf-8", "replace"), digest_size=16).digest() for unit in own]
                counts = [len(place) for place in places]
                place = np.concatenate(places)
                digest = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                of = np.repeat(np.arange(len(part)), counts)
                out = pd.DataFrame(place, columns=["start", "end", "n_words"])
                out.insert(0, "doc_id", part["doc_id"].astype("Int64").array[of])
                out.insert(1, "row", part["row"].to_numpy()[of])
                yield out.assign(high=digest[:, 0], low=digest[:, 1])

    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        (F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()).alias("row"),
    )
    return base.mapInPandas(run, "doc_id long, row long, start int, end int, n_words int, high long, low long")


def repeats(
    docs: DataFrame, least: int = LEAST_WORDS, short: bool = False, row: str | None = None, lines: bool = False
) -> DataFrame:
    """One row per removed unit.

    doc_id, start, end and n_words of the removed occurrence, kept_doc_id and
    kept_start of the one that stays, copies (occurrences in all), row. ``row`` names
    a column of written row numbers; without it rows are numbered here.
    """
    docs = docs.select("doc_id", "text", *([F.col(row).alias(ROW)] if row else []))
    table = written(unit_table(docs, least, short, lines), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "start")
    groups = (
        table.groupBy("high", "low")
        .agg(F.min(rank).alias("kept"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    return (
        table.join(groups, ["high", "low"])
        .where((F.col("row") != F.col("kept.row")) | (F.col("start") != F.col("kept.start")))
        .select(
            "doc_id", "start", "end", "n_words", F.col("kept.doc_id").alias("kept_doc_id"),
            F.col("kept.start").alias("kept_start"), "copies", "row",
        )
    )


def without_repeats(
    docs: DataFrame, least: int = LEAST_WORDS, short: bool = False, lines: bool = False
) -> DataFrame:
    """``docs`` with repeated units cut out of ``text``, all columns kept, and the
    array ``removed`` of struct(start, end) in the original text.

    The rows are written once with a row number, by which spans come back to them.
    """
    number = free(docs, ROW)
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    spans = repeats(rows, least, short, number, lines).select(F.col("row").alias(number), "start", "end")
    removed = spans.groupBy(number).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, removed: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(text, removed):
            kept, at = [], 0  # spans come by start and may overlap
            for s in spans if spans is not None else []:
                kept.append(t[at : s["start"]] if s["start"] > at else "")
                at = max(at, s["end"])
            out.append(t if t is None else "".join(kept) + t[at:])
        return pd.Series(out)

    joined = rows.join(removed, number, "left")
    cut_text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(cut("text", "removed"))
    return joined.withColumn("text", cut_text).select(*docs.columns, "removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), lines=True).drop("row")
