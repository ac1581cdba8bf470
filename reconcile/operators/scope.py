"""Narrowing work to what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reconcile import KEY
from reconcile.functions import checksums as ck, kinds, paths
from reconcile.functions.text import strip


#: Bits that say which strings are wanted: 128 KB however many there are.
WANTED_BITS = 1 << 20


def _place(text: F.Column) -> tuple[F.Column, F.Column]:
    """Number of the word and the bit in it that stand for a string."""
    h = F.xxhash64(text)
    word = F.pmod(F.shiftright(h, 6), F.lit(WANTED_BITS // 64)).cast("int")
    return word, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))


def _wanted_bits(wanted: DataFrame, col: str) -> F.Column:
    """The hashes of ``col`` as a bit set, an array of ``WANTED_BITS`` / 64 numbers."""
    word, bit = _place(F.col(col))
    found = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = wanted.sparkSession.range(WANTED_BITS // 64).select(F.col("id").cast("int").alias("word"))
    dense = every.join(found, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    return dense.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["bits"])).scalar()


def _maybe(bits: F.Column, text: F.Column) -> F.Column:
    """False only where ``text`` is surely not among the wanted strings."""
    word, bit = _place(text)
    return F.get(bits, word).bitwiseAND(bit) != 0


def _suffixes(col: str) -> F.Column:
    n = F.length(col)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(col), i, n))


def keys_for_changed_paths(
    manifest: DataFrame, transitions: DataFrame, changed: DataFrame
) -> DataFrame:
    """Qualified keys touched by changed ``path`` rows.

    Exact object path first, then exact change-script path; a path matching
    neither falls back to a character-wise suffix match in either direction.
    Both directions are equi joins on spelled-out suffixes: changed paths are
    expanded fully, and the inventory only by suffix lengths that occur.  Where the
    inventory lies, every piece is first looked up in a bit set of the wanted
    hashes, so only pieces that may match are shuffled and compared.  Whole paths
    are shuffled once, for the exact match, and the first direction reuses that.
    """
    objects = manifest.select(F.col("object_path").alias("path"), "normalized_key")
    scripts = transitions.select("path", "normalized_key")
    known = objects.withColumn("rank", F.lit(0)).unionByName(
        scripts.withColumn("rank", F.lit(1))
    )
    wanted = changed.select(
        F.nullif(paths.forward_slashes(strip(F.col("path"))), F.lit("")).alias("path")
    ).filter(F.col("path").isNotNull()).distinct()

    # min_by over the rank keeps the object when a path names both.
    exact = wanted.join(known, "path", "inner").groupBy("path").agg(
        F.min_by("normalized_key", "rank").alias("normalized_key")
    )
    loose = wanted.join(known.select("path"), "path", "left_anti")

    # Direction 1: the changed path ends with a known path.
    tails = loose.select(F.explode(_suffixes("path")).alias("path")).distinct()
    longer = known.join(tails, "path", "left_semi").select("path", "normalized_key")

    # Direction 2: a known path ends with the changed path.  The scalar
    # subquery holds distinct lengths, at most the longest path many numbers.
    lengths = loose.agg(F.collect_set(F.length("path")).alias("ns")).scalar()
    cut = F.substring("path", F.length("path") - F.col("k") + 1, F.col("k"))
    pieces = (
        known.select("path", "normalized_key", lengths.alias("ns"))
        .select("path", "normalized_key", F.explode("ns").alias("k"))
        .filter(F.col("k") <= F.length("path"))
        .select("path", "normalized_key", cut.alias("tail"))
        .filter(_maybe(_wanted_bits(loose, "path"), F.col("tail")))
    )
    shorter = pieces.join(
        loose.withColumnRenamed("path", "tail"), "tail", "left_semi"
    ).select("path", "normalized_key")

    hits = exact.select("path", "normalized_key").unionByName(longer).unionByName(shorter)
    db = F.split("path", "/")[0]
    return hits.select(
        db.alias("database_name"), "normalized_key"
    ).distinct().withColumn(
        "snapshot_key", paths.snapshot_key(F.col("database_name"), F.col("normalized_key"))
    )


def expand_delta(delta: DataFrame, manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Delta plus the parent table of every trigger in it.

    Only triggers expand and only to managed tables, so one step is the closure.
    """
    own = delta.select(*KEY)
    triggers = manifest.filter(F.col("kind") == "triggers").select(*KEY, "schema_name")
    named = catalog.filter(
        (F.col("kind") == "triggers") & (F.coalesce("parent_name", F.lit("")) != "")
    ).select(*KEY, "parent_name")
    parents = (
        triggers.join(own, KEY, "left_semi")
        .join(named, KEY, "inner")
        .select(
            "database_name",
            paths.normalized_key(
                F.col("schema_name"), F.lit("tables"), F.col("parent_name")
            ).alias("normalized_key"),
        )
        .distinct()
        .join(manifest.filter(F.col("kind") == "tables").select(*KEY), KEY, "left_semi")
    )
    return own.unionByName(parents).distinct().withColumn(
        "snapshot_key", paths.snapshot_key(F.col("database_name"), F.col("normalized_key"))
    )


def git_scope(
    manifest: DataFrame, transitions: DataFrame, changed: DataFrame, catalog: DataFrame
) -> DataFrame:
    """Managed keys in the closure of the changed paths."""
    delta = keys_for_changed_paths(manifest, transitions, changed)
    return manifest.select(*KEY, "schema_name", "kind", "object_name").join(
        expand_delta(delta, manifest, catalog).select(*KEY), KEY, "left_semi"
    )


def layout_digest(files: DataFrame, fan_out: int = 4096) -> DataFrame:
    """One digest over the set of script paths.

    Paths are spread over ``fan_out * fan_out`` leaves by their hash. A leaf is
    digested from its sorted, length-prefixed paths, a bucket from its leaves and
    the whole from its buckets, so no task gathers more than ``fan_out`` digests,
    and a leaf holds a few paths up to 10^10 of them. There is one definition for
    trees of every size; ``fan_out`` is part of it.
    """
    spread = F.conv(F.substring(F.sha2("path", 256), 1, 12), 16, 10).cast("long")
    digest = lambda order: F.sha2(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "d"))), lambda r: r["d"]), "\n"), 256
    )
    leaves = (
        files.select("path").distinct()
        .groupBy((spread % fan_out).alias("bucket"), (F.floor(spread / fan_out) % fan_out).alias("leaf"))
        .agg(F.sort_array(F.collect_list("path")).alias("ps"), F.count(F.lit(1)).alias("n"))
        .withColumn(
            "d", F.sha2(F.unhex(F.array_join(F.transform("ps", ck.length_prefixed_hex), "")), 256)
        )
    )
    buckets = leaves.groupBy("bucket").agg(digest("leaf").alias("d"), F.sum("n").alias("n"))
    return buckets.agg(
        F.when(F.count(F.lit(1)) == 0, F.sha2(F.lit(""), 256)).otherwise(digest("bucket"))
        .alias("layout_digest"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("scripts"),
    )


def spot_check(stable: DataFrame, digest: str, n: int = 8) -> DataFrame:
    """Per database the ``n`` stable keys with the smallest keyed hash.  The
    rank filter runs before the shuffle too, so tasks ship ``n`` rows each."""
    ranked = stable.select(
        *KEY, ck.spot_rank(F.lit(digest), F.col("normalized_key")).alias("spot_rank")
    )
    order = Window.partitionBy("database_name").orderBy("spot_rank", "normalized_key")
    return (
        ranked.withColumn("pos", F.row_number().over(order))
        .filter(F.col("pos") <= n)
        .select(*KEY, "spot_rank")
    )


def hot_or_stable(manifest: DataFrame, delta: DataFrame, latest: DataFrame) -> DataFrame:
    """State per key before the spot check: hot rows must be inspected."""
    prior = latest.select(*KEY, F.col("checksum").alias("prior"))
    flagged = delta.select(*KEY).distinct().withColumn("_delta", F.lit(True))
    hot = (
        kinds.is_module(F.col("kind"))
        | F.col("_delta").isNotNull()
        | ~ck.present(F.col("prior"))
        | (F.col("prior") != F.col("checksum"))
    )
    return (
        manifest.join(prior, KEY, "left")
        .join(flagged, KEY, "left")
        .select(*KEY, "kind", F.when(hot, "hot").otherwise("stable").alias("state"))
    )


def inspect_scope(
    manifest: DataFrame,
    delta: DataFrame,
    latest: DataFrame,
    digest: str,
    full: bool = False,
    n: int = 8,
) -> DataFrame:
    """hot/stable per managed key, spot-checked rows turned hot."""
    if full:
        return manifest.select(*KEY, "kind", F.lit("hot").alias("state"))
    rows = hot_or_stable(manifest, delta, latest)
    if n <= 0:
        return rows
    picked = spot_check(rows.filter("state = 'stable'"), digest, n).select(
        *KEY, F.lit(True).alias("_picked")
    )
    return rows.join(picked, KEY, "left").select(
        *KEY,
        "kind",
        F.when(F.col("_picked"), "hot").otherwise(F.col("state")).alias("state"),
    )


def scope_verdict(scope: DataFrame) -> DataFrame:
    """Per database: counts, whether everything is hot, whether nothing is."""
    hot = F.count_if(F.col("state") == "hot")
    total = F.count(F.lit(1))
    return scope.groupBy("database_name").agg(
        hot.alias("hot"),
        total.alias("total"),
        (hot == total).alias("full_inspect"),
        (hot == 0).alias("allow_cache"),
    )


# Sources of changed paths from most to least explicit.  Only the
# sources named in NEEDS_ROWS are passed over when they list nothing.
CHANGE_SOURCES = [
    "env-full-inspect", "env-changed-files", "env-git-base", "env-git-base-failed",
    "env-git-base-no-git", "no-git", "ci-github-pr", "ci-gitlab-mr", "ci-ado-pr",
    "git-merge-base", "git-head", "git-head-parent",
]
FULL_SOURCES = ["env-full-inspect", "env-git-base-failed", "env-git-base-no-git", "no-git"]
NEEDS_ROWS = ["env-changed-files", "git-merge-base", "git-head", "git-head-parent"]


def choose_source(candidates: DataFrame) -> DataFrame:
    """The winning source of (source, path) rows, with ``full_inspect``.

    A source that was asked but listed nothing is one row with a NULL path.
    With no usable source at all the answer is the empty change set of the head.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in CHANGE_SOURCES]), F.col("source"))
    usable = candidates.filter(
        F.col("path").isNotNull() | ~F.col("source").isin(NEEDS_ROWS)
    ).filter(rank > 0)
    win = F.coalesce(F.min_by("source", rank), F.lit("git-head"))
    return usable.agg(win.alias("source")).withColumn(
        "full_inspect", F.col("source").isin(FULL_SOURCES)
    )


def choose_changed(candidates: DataFrame, prefix: str = "sql/") -> DataFrame:
    """Normalised changed paths of the winning source; none for a full inspect."""
    win = choose_source(candidates).select(
        F.when(~F.col("full_inspect"), F.col("source"))
    ).scalar()
    return (
        candidates.filter(F.col("source") == win)
        .select("source", paths.normalize_path(F.col("path"), prefix).alias("path"))
        .filter(F.col("path").isNotNull())
    )
