"""Best-fit packing planned on the histogram of lengths.

Documents are tokenised in Arrow batches; only lengths and checksums leave the
task. The planner sees one count per length (at most ``CAPACITY`` rows, whatever
the corpus size) and runs best-fit decreasing over groups of equally full
sequences. Documents then take planned slots by their rank among equally long
pieces. Ranks are two-level: counts per (length, bucket) give each bucket its
first rank, so that a length that a third of all pieces share is numbered by
many tasks.

Tokens: the tokenizer's own ids. Texts of ASCII and plain Latin letters take a
shortcut with the same result: the vocabulary splits such text into words first
and a word's ids don't depend on its surroundings, so each distinct word is
encoded once per Python worker and remembered across tasks. All other texts go to the tokenizer whole.

Defined cases: null and empty texts are one end token; texts longer than the
capacity are cut into pieces; a repeated doc_id is packed once per row; a null
doc_id is packed like any other. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import worker
from .components import written

CAPACITY = 4096
END = 1
#: Words remembered by one Python worker; above it the memory starts anew.
REMEMBERED = 500_000
#: Documents whose words are looked up together.
TOGETHER = 256
#: Pieces numbered by one window partition, about.
RANK_ROWS = 50_000

#: Latin letters whose lower case is one of them too; others, such as U+018F, go to the tokenizer.
_LATIN = "".join(c for c in map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x250)]) if len(c.lower()) == 1 and c.lower() < "\u0250")
_PLAIN = re.compile(rf"[\t-\r\x20-\x7e{_LATIN}]*")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^\sa-z0-9{_LATIN}]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [bool(_PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        words = [_WORDS.findall(t.lower()) if p else None for t, p in zip(texts, plain)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*[w for w in words if w is not None]).difference(self.known))
        self.known.update(zip(new, self.whole(new)))
        rest = iter(self.whole([t for t, p in zip(texts, plain) if not p]))
        known = self.known
        return [next(rest) if w is None else b"".join(map(known.__getitem__, w)) for w in words]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker, with the words it remembers.

    Tasks keep the cores busy by themselves; threads of the tokenizer for single words would cost more than they gain.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents cut at the capacity."""

    def run(batches):
        worker.enter("packing", encoder.cache_clear)
        encode, last = encoder(tokenizer), array("I", [end]).tobytes()
        for b in batches:
            for at in range(0, len(b), TOGETHER):
                rows = b.iloc[at : at + TOGETHER]
                out = []
                for doc_id, ids in zip(rows["doc_id"].astype("Int64"), encode([t or "" for t in rows["text"]])):
                    ids += last
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        out.append((doc_id, k, start // 4, len(part) // 4, zlib.crc32(part)))
                out = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))
        worker.release()

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, first_rank, ranks, first_sequence, each, first_offset): the
    pieces of ``length`` with these ranks fill sequences from ``first_sequence``
    on, ``each`` of them side by side per sequence from ``first_offset`` on.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # space left: runs of (first sequence, sequences)
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            space = min((r for r in room if r >= length), default=None)
            if space is None:
                space, need = capacity, -(-left // (capacity // length))
                room[space] = [(sequences, need)]
                sequences += need
            first, count = room[space].pop()
            if not room[space]:
                del room[space]
            each = min(space // length, left)
            used = min(count, left // each)
            out.append((length, rank, used * each, first, each, capacity - space))
            rank, left = rank + used * each, left - used * each
            if count > used:
                room.setdefault(space, []).append((first + used, count - used))
            if space > each * length:
                room.setdefault(space - each * length, []).append((first, used))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a table that can be read again) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per length
    total = sum(r["n"] for r in counts)
    slots = spark.createDataFrame(
        plan({r["length"]: r["n"] for r in counts}, capacity),
        "length long, first_rank long, ranks long, first_sequence long, each long, first_offset long",
    )
    buckets = -(-max(total, 1) // RANK_ROWS)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("at", F.row_number().over(within))
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("at") - 1)
    )
    place = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(slots, "length")
        .where((place >= 0) & (place < F.col("ranks")))
        .select(
            *pieces.columns,
            (F.col("first_sequence") + F.expr("(rank - first_rank) div each")).alias("sequence_id"),
            (F.col("first_offset") + F.pmod(place, F.col("each")) * F.col("length")).alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(pieces(docs, tokenizer or tokenizer_path(), capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
