"""Periodic runs of words: stretches that repeat one unit three times or more.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are
equal) and at least ``max(24, 3 q)`` words that no neighbouring word extends. All
runs of a text are found, by two means:

* Periods up to ``DIRECT`` words: the text is compared with itself at each lag.
* Longer periods, in scales ``(low, high]`` with ``high`` about 1.5 ``low``: every
  ``high`` consecutive words get a hash, and a position is selected where its hash
  is the minimum of one of the windows of ``W`` positions it lies in. Inside a run
  windows a period apart have equal content, so selected positions repeat at
  period distance. ``high >= q`` makes a hash cover a whole period, so no equal
  stretch lies nearer than ``q`` in a run; ``W = 2 (low + 1) - high + 1`` lets two
  such windows fit into three periods. Hence the next selected position with
  an equal hash is exactly one period on, and every run has such a pair. Pairs of
  equal distance whose stretches touch are joined, and both ends are extended.

Stretches found with several periods are one run of the smallest of them.

Words are numbered exactly; stretches are compared by 64-bit hashes built by
doubling, so a wrong comparison has a probability near 2**-64 each.

Scale: texts are independent, nothing is shuffled. Inside a task many texts are
laid end to end, longest first, with unlike separators between them, so that numpy
works on long arrays and a scale sees only the texts long enough for it. Time is
n log n in the words of a text, memory a few arrays of its length. Whole texts
are read and a single text is never cut.

Defined cases: null and empty texts and texts of white space alone have no words,
no runs and an empty collapsed text. A null doc_id is kept. Repeated rows give one
row each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 24
TIMES = 3
#: Periods up to this are found by comparing the text with itself at each lag.
DIRECT = 16
#: Bytes of text laid end to end in one task at a time; one longer text is taken alone.
TOGETHER = 2_000_000

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the pairs (a, b)."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _slid(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = least(x[:-have], x[have:])
        have *= 2
    return least(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _extended(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: int, step: int) -> np.ndarray:
    """How many words from ``a`` on equal those from ``b`` on (before them if step < 0)."""
    at = np.zeros(len(a), dtype=np.int64)

    def equal(rows, size):
        lo, hi = a[rows] + step * at[rows], b[rows] + step * at[rows]
        if step < 0:
            lo, hi = lo - size, hi - size
        rows = rows[(lo >= 0) & (hi + size <= n)]
        lo, hi = a[rows] + step * at[rows], b[rows] + step * at[rows]
        if step < 0:
            lo, hi = lo - size, hi - size
        return rows[levels[size.bit_length() - 1][lo] == levels[size.bit_length() - 1][hi]]

    size = 1 << (len(levels) - 1)
    rows = np.arange(len(a))
    while len(rows := equal(rows, size)):
        at[rows] += size
    while size := size >> 1:
        at[equal(np.arange(len(a)), size)] += size
    return at


def find_runs(ids: np.ndarray, sizes: np.ndarray, direct: int = DIRECT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of every run.

    ``ids`` are texts of ``sizes`` words, longest first, each followed by a number
    that occurs nowhere else.
    """
    found = [np.zeros((3, 0), dtype=np.int64)]
    for lag in range(1, min(direct, len(ids) - 1) + 1):
        same = np.flatnonzero(ids[lag:] == ids[:-lag])
        if not len(same):
            continue
        ends = np.append(np.flatnonzero(np.diff(same) != 1), len(same) - 1)
        first = same[np.insert(ends[:-1] + 1, 0, 0)]
        length = same[ends] - first + 1 + lag
        long = length >= max(LEAST, TIMES * lag)
        found.append(np.stack([first[long], length[long], np.full(long.sum(), lag)]))

    levels = [_mixed(ids.astype(np.uint64) + np.uint64(1), np.uint64(0x2545F4914F6CDD1D))]
    offsets = np.cumsum(sizes + 1)
    low = direct
    while True:
        texts = int(np.searchsorted(-sizes, -max(LEAST, TIMES * (low + 1)), side="right"))
        if not texts:
            break
        n = int(offsets[texts - 1])
        high = 3 * (low + 1) // 2
        while 2 << (len(levels) - 1) <= high:
            half = 1 << (len(levels) - 1)
            last = levels[-1][: n - half + 1]
            levels.append(_mixed(last[:-half], last[half:]))
        part = 1 << (len(levels) - 1)
        base = levels[-1][: n - part + 1]
        hashes = _mixed(base[: n - high + 1], base[high - part :])
        width = 2 * (low + 1) - high + 1
        minima = _slid(hashes, width, np.minimum)
        border = np.zeros(width - 1, dtype=np.uint64)
        selected = np.flatnonzero(_slid(np.concatenate([border, minima, border]), width, np.maximum) == hashes)
        order = np.argsort(hashes[selected], kind="stable")
        at = selected[order]
        gap = np.diff(at)
        pair = (hashes[at[1:]] == hashes[at[:-1]]) & (gap > low) & (gap <= high)
        a, d = at[:-1][pair], gap[pair]
        if len(a):
            order = np.lexsort((a, d))
            a, d = a[order], d[order]
            apart = np.flatnonzero((np.diff(d) != 0) | (np.diff(a) > high))
            head = a[np.insert(apart + 1, 0, 0)]
            tail = a[np.append(apart, len(a) - 1)] + high
            d = d[np.append(apart, len(d) - 1)]
            start = head - _extended(levels, head, head + d, n, -1)
            length = tail + _extended(levels, tail, tail + d, n, 1) + d - start
            long = length >= np.maximum(LEAST, TIMES * d)
            found.append(np.stack([start[long], length[long], d[long]]))
        low = high
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    again = np.zeros(len(start), dtype=bool)
    again[1:] = (start[1:] == start[:-1]) & (length[1:] == length[:-1])
    return start[~again], length[~again], period[~again]


def _analysed(texts: list[bytes]) -> list[tuple[int, list[dict], bytes]]:
    """Word count, runs and collapsed text of each text."""
    words = [t.split() for t in texts]  # bytes split at ASCII white space only
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    sizes = np.array([len(words[i]) for i in order], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    ids = np.empty(offsets[-1], dtype=np.int64)
    inside = np.ones(len(ids), dtype=bool)
    inside[offsets[1:] - 1] = False
    flat = np.array([w for i in order for w in words[i]] or [b""], dtype=object)[: inside.sum()]
    numbers, names = pd.factorize(flat)
    ids[inside] = numbers
    ids[~inside] = len(names) + np.arange(len(order))
    start, length, period = find_runs(ids, sizes)

    marks = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    kept = np.cumsum(marks)[:-1] == 0
    text_of = np.searchsorted(offsets, start, side="right") - 1
    out: list[tuple[int, list[dict], bytes]] = [(len(w), [], b"") for w in words]
    first = np.searchsorted(text_of, np.arange(len(order) + 1))
    for k, i in enumerate(order):
        mine = range(first[k], first[k + 1])
        if not mine:
            out[i] = (len(words[i]), [], b" ".join(words[i]))
            continue
        runs = sorted((int(start[j] - offsets[k]), int(period[j]), int(length[j])) for j in mine)
        stay = kept[offsets[k] : offsets[k] + sizes[k]]
        out[i] = (
            len(words[i]),
            [{"start": s, "length": n, "period": p} for s, p, n in runs],
            b" ".join(w for w, s in zip(words[i], stay) if s),
        )
    return out


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    ``collapsed`` is the text without the words that repeat a run's first period,
    joined by one space. ``docs`` needs doc_id and text.
    """

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
                    size += len(texts[end])
                    end += 1
                n, runs, collapsed = zip(*_analysed(texts[at:end]))
                kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, end - at), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
                at = end

    text = F.col("text").cast("string").cast("binary")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return base.mapInArrow(run, SCHEMA)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period; of equals the earliest, then the shortest period."""

    def compare(x: Column, y: Column) -> Column:
        by_power = F.signum(y["length"] * x["period"] - x["length"] * y["period"])
        by_start = F.signum(x["start"] - y["start"])
        by_period = F.signum(x["period"] - y["period"])
        return F.coalesce(F.nullif(by_power, F.lit(0.0)), F.nullif(by_start, F.lit(0.0)), by_period).cast("int")

    return F.get(F.array_sort(runs, compare), F.lit(0))


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document with its tail replaced by a repeated unit.

    With h the CRC of the id, g = h div 10 and n words, the words from a = g mod n
    on become repeats of the first 1 + (n - a) div (3 + g mod 8) of them.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
    unit = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    edited = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), edited).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    edited = docs.select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(edited).withColumn("top", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
