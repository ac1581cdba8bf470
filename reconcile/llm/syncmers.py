"""Document fingerprints from closed syncmers over word tokens.

A text is cut into tokens: runs of up to 24 letters and digits, and every other
visible character alone, as is each one of a longer run or of a script without
spaces. A k-mer of tokens is an anchor when the smallest hash
of its inner s-mers lies at its first or last place. Whether a k-mer is an
anchor depends on its own tokens only, so an edit elsewhere moves no anchor and
anchors of two texts can be matched by position. The fingerprint is the sorted
list of all distinct anchor hashes; likeness is the share of common ones among
those of both (Jaccard).

All expressions are built-in column functions; arrays used inside lambdas are
columns of their own, so that nothing is evaluated per element twice.

Scale: one shuffle, in which documents travel with their text by ranges of
doc_id to find their successor; fingerprints are made after it. Ranges hold about
a thousand rows each, by quantiles of doc_id (``MOST_RANGES`` at most, so that
the bounds the driver sends out are bounded); an id that fills several ranges is
cut further by the first two bytes of its texts. The step from one range to the
next takes one row per range.

Defined cases: null text is empty; a text without an anchor, as all with fewer
than k tokens, has the hash of all tokens as its one anchor, so empty texts share
a fingerprint and different short texts don't; equal texts
have equal fingerprints; rows with equal doc_id are ordered by text. Rows
without doc_id come first. An empty table gives no rows. Rows of one id whose
texts begin alike are ordered in one task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Letters and digits of scripts that put spaces between words.
_SPACED = (
    r"[\p{L}\p{N}&&[^\p{IsIdeographic}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}"
    r"\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]]"
)
TOKENS = rf"(?<!{_SPACED}){_SPACED}{{1,24}}(?!{_SPACED})|[^\s]"
K, S = 6, 2
RANGE_ROWS = 1000
MOST_RANGES = 50_000
RANGES_TOGETHER = 1000
#: An id that is this many quantiles in a row is cut by its texts.
HOT = 3
PREFIXES = 1 << 16


def _least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Add ``out``: array of struct(position, hash), the anchors of column ``text``.

    ``position`` counts tokens from 0.
    """
    inner = k - s  # last place of an s-mer in a k-mer
    h, m = f"__h_{out}", f"__m_{out}"
    n = F.size(h)
    at = lambda a, i, j: F.get(F.col(a), i + F.lit(j))
    hashed = df.withColumn(h, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKENS), F.lit(0)), lambda w: F.xxhash64(w)))
    with_m = hashed.withColumn(
        m,
        F.when(n >= s, F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[at(h, i, j) for j in range(s)])))
        .otherwise(F.array().cast("array<bigint>")),
    )
    starts = F.filter(
        F.sequence(F.lit(0), n - k),
        lambda i: _least([at(m, i, 0), at(m, i, inner)]) <= _least([at(m, i, j) for j in range(1, inner)]),
    )
    whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(F.col(h)).alias("hash")))
    found = F.when(
        n >= k,
        F.transform(starts, lambda i: F.struct(i.alias("position"), F.xxhash64(*[at(h, i, j) for j in range(k)]).alias("hash"))),
    ).otherwise(F.array().cast("array<struct<position:int,hash:bigint>>"))
    some = F.when(F.size(out) > 0, F.col(out)).otherwise(whole)
    return with_m.withColumn(out, found).withColumn(out, some).drop(h, m)


def sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the distinct anchor hashes of ``text``, sorted; at least one."""
    a = f"__a_{out}"
    return anchors(df, text, a).withColumn(out, F.sort_array(F.array_distinct(F.col(f"{a}.hash")))).drop(a)


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two fingerprints; 1 for equal, 0 for null."""
    shared = F.size(F.array_intersect(F.col(a), F.col(b)))
    return (
        F.when(F.col(a).isNull() | F.col(b).isNull(), 0.0)
        .when(F.col(a) == F.col(b), 1.0)
        .otherwise(shared.cast("double") / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1)))
    )


def as_text(column: str) -> Column:
    return F.concat_ws(",", F.transform(F.col(column), lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))))


def _bounds(docs: DataFrame, range_rows: int) -> tuple[list[int], list[int]]:
    """Where ranges of doc_id begin, and the ids that fill several ranges."""
    n = docs.where("doc_id is not null").count()
    ranges = min(n // range_rows, MOST_RANGES)
    if ranges < 2:
        return [], []
    shares = F.lit([(i + 1) / ranges for i in range(ranges - 1)])
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 4 * ranges).alias("c")).first().c
    hot = sorted(v for v, times in Counter(cuts).items() if times >= HOT)
    ends = [v + 1 for v in hot if v < (1 << 63) - 1]
    return sorted({*cuts, *ends}), hot


def _place(bounds: list[int]) -> Column:
    """How many of ``bounds`` doc_id has reached, found in two steps of their square root."""
    if not bounds:
        return F.lit(0).cast("long")
    step = math.isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda values: F.lit(values).cast("array<bigint>")
    reached = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    block = reached(longs([b[0] for b in blocks]))
    inside = F.coalesce(reached(F.get(F.array(*[longs(b) for b in blocks]), block - 1)), F.lit(0))
    return (F.greatest(block - 1, F.lit(0)) * step + F.greatest(inside, F.lit(0))).cast("long")


def with_next(
    docs: DataFrame,
    order: list[str],
    range_rows: int = RANGE_ROWS,
    add: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Add ``next_<c>`` of the row with the next doc_id; after the last, the first.

    Rows are dealt to ranges of doc_id and ordered by ``order`` within
    each; the last row of a range takes the first row of the next range that has
    rows. Both uses of the ordered rows read one exchange, after which ``add`` adds columns.
    """
    bounds, hot = _bounds(docs, range_rows)
    place = F.coalesce(F.when(F.col("doc_id").isNotNull(), _place(bounds)), F.lit(-1).cast("long"))
    within = F.lit(0).cast("long")
    if "text" in order:
        # the first two bytes keep the order of texts; rows without doc_id are one id
        start = F.rpad(F.hex(F.substring(F.encode("text", "utf-8"), 1, 2)), 4, "0")
        prefix = F.conv(start, 16, 10).cast("long")
        is_hot = F.col("doc_id").isNull()
        if hot:
            is_hot = is_hot | F.array_contains(F.lit(hot).cast("array<bigint>"), F.col("doc_id"))
        within = F.when(is_hot, prefix).otherwise(within)
    # never null, so that the join below filters nothing and both uses share their exchange
    dealt = docs.withColumn("__range", F.coalesce(place * PREFIXES + within, F.lit(0).cast("long")))
    ranged = dealt.repartition("__range").sortWithinPartitions(
        "__range", *[F.col(c).asc_nulls_first() for c in order]
    )
    w = Window.partitionBy("__range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    here = F.lit(True)
    full = add(ranged)
    columns = [c for c in full.columns if c != "__range"]
    following = full.select("*", F.lead(here).over(w).alias("__more"), *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    first = add(ranged.withColumn("__before", F.lag(here).over(w)).where(F.col("__before").isNull()))
    # successor of each range, first inside blocks of ranges, then across blocks
    ids = dealt.select("__range").distinct().withColumn("__block", F.expr(f"__range div {PREFIXES * RANGES_TOGETHER}L"))
    inside = ids.withColumn("__to", F.lead("__range").over(Window.partitionBy("__block").orderBy("__range")))
    blocks = ids.groupBy("__block").agg(F.min("__range").alias("__start"))
    # at most MOST_RANGES / RANGES_TOGETHER rows, twice that with the ends of hot ids
    around = Window.orderBy("__block")
    begin = F.min("__start").over(Window.partitionBy())
    blocks = blocks.select("__block", F.coalesce(F.lead("__start").over(around), begin).alias("__after"))
    succ = inside.join(blocks, "__block").select(F.col("__range").alias("__of"), F.coalesce("__to", "__after").alias("__to"))
    step = first.join(succ, F.col("__range") == F.col("__to")).select("__of", *[F.col(c).alias(f"__first_{c}") for c in columns])
    return following.join(step, F.col("__range") == F.col("__of"), "left").select(
        *columns,
        *[F.when(F.col("__more"), F.col(f"next_{c}")).otherwise(F.col(f"__first_{c}")).alias(f"next_{c}") for c in columns],
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``fingerprint`` (array of long) of each document."""
    return sketch(_texts(docs), "text", "fingerprint")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text and of its successor."""
    paired = with_next(_texts(docs), ["doc_id", "text"], add=lambda df: sketch(df, "text", "fingerprint"))
    paired = paired.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    text = F.concat(
        F.left(F.col("text"), F.col("n_chars").cast("int") - half), F.left(F.col("next_text"), half)
    )
    return sketch(paired.withColumn("edited_text", text), "edited_text", "edited_fingerprint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text"), 256).alias("edited_sha256"),
        as_text("fingerprint").alias("fingerprint"),
        as_text("edited_fingerprint").alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
