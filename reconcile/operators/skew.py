"""Equi joins in which few keys hold most rows of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys that may be cut; any key above a 64th of all rows is among them.
HOT_KEYS = 64
#: Parts a hot key is cut into, and copies of its right rows.
PARTS = 64


def heavy_keys(df: DataFrame, keys: list[str], most: int = HOT_KEYS) -> DataFrame:
    """The keys with most rows, ``most`` at the most; counted per task first."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    return counts.orderBy(F.desc("_rows"), *keys).limit(most).select(*keys)


def spread_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", parts: int = PARTS
) -> DataFrame:
    """``left.join(right, keys, how)`` for ``inner`` and ``left``, with the rows of
    heavy left keys cut into ``parts`` by their hash.

    Right rows of those keys are copied to every part; all others join plainly.
    The list of heavy keys is broadcast, as it has ``HOT_KEYS`` rows at most.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"spread_join can't do a {how} join")
    hot = F.broadcast(heavy_keys(left, keys).withColumn("_hot", F.lit(True)))
    own = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(parts)).cast("int")
    cut = left.join(hot, keys, "left").withColumn(
        "_part", F.when(F.col("_hot"), own).otherwise(0)
    ).drop("_hot")
    last = F.when(F.col("_hot"), F.lit(parts - 1)).otherwise(0)
    copies = right.join(hot, keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), last))
    ).drop("_hot")
    return cut.join(copies, [*keys, "_part"], how).drop("_part")
