"""Run timings, latency and allocation roll-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from reconcile.functions import text
from reconcile.operators.ordered import BLOCK, previous

# How each timing column of parallel runs combines.
MERGE_MAX = ["connect_ms", "parallel_wall_ms"]
MERGE_SUM = [
    "ensure_ms", "checksums_ms", "inspect_ms", "diff_ms", "apply_ms",
    "plan_db_query_ms", "plan_db_query_calls",
]
SLO_MAX_PARALLEL_MS = 500


def merge_timings(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Timings of per-database runs merged per ``by`` group.  ``seq`` orders the
    runs: the last non-empty path label wins."""
    path = F.max_by(
        "plan_db_path",
        F.when(F.coalesce("plan_db_path", F.lit("")) != "", F.col("seq")),
    )
    return runs.groupBy(*(by or [])).agg(
        *[F.max(c).alias(c) for c in MERGE_MAX],
        *[F.sum(c).alias(c) for c in MERGE_SUM],
        F.bool_and("l1_cache_hit").alias("l1_cache_hit"),
        path.alias("plan_db_path"),
    )


def derive_timings(runs: DataFrame) -> DataFrame:
    """Composite fields that are computed, not measured."""
    wall = F.greatest(F.col("ensure_ms"), F.col("checksums_ms") + F.col("inspect_ms"))
    return runs.withColumns({
        "audit_ms": F.col("ensure_ms") + F.col("checksums_ms"),
        "engine_ms": F.col("plan_wall_ms") - F.col("connect_ms"),
        "parallel_wall_ms": F.when(F.col("parallel_wall_ms") > 0, F.col("parallel_wall_ms"))
        .otherwise(wall),
    })


def slo_violations(runs: DataFrame, max_ms: int = SLO_MAX_PARALLEL_MS) -> DataFrame:
    """Runs over the wall limit.  Cache hits and cold full reads are exempt."""
    return runs.filter(
        ~slo_exempt("plan_db_path", "l1_cache_hit") & (F.col("parallel_wall_ms") > max_ms)
    )


def slo_exempt(path: str = "plan_db_path", hit: str = "l1_cache_hit"):
    return F.coalesce(F.col(hit), F.lit(False)) | F.coalesce(
        F.col(path) == "cold_full", F.lit(False)
    )


#: Milliseconds a bucket of the first pass spans.
BUCKET_MS = 65_536


def latency_summary(
    runs: DataFrame, by: list[str], qs=(0.5, 0.95), bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """Nearest-rank percentiles of whole-millisecond ``wall_ms`` per group.

    The value at index ``min(n - 1, int(q * n))`` of the sorted walls; runs
    without a wall count to ``n`` and rank first.  Ranks are searched in two
    passes: over a group's buckets of ``bucket_ms``, then over the distinct
    milliseconds of the one bucket a rank lies in.  Runs are counted per
    millisecond first, which folds ties map-side, so the ordered passes see at
    most ``bucket_ms`` rows of a group each for walls up to ``bucket_ms ** 2``
    (49 days), however many runs and distinct values it has.
    """
    counted = runs.withColumn(
        "_bucket", F.floor(F.col("wall_ms") / F.lit(bucket_ms))
    ).groupBy(*by, "_bucket", "wall_ms").agg(
        F.count("wall_ms").alias("c"), F.count(F.lit(1)).alias("r"),
        F.count_if(F.col("failed")).alias("f"),
    )
    buckets = counted.groupBy(*by, "_bucket").agg(
        F.sum("c").alias("c"), F.sum("r").alias("r"), F.sum("f").alias("f"),
        F.max("wall_ms").alias("max"),
    )
    w = Window.partitionBy(*by)
    ranked = buckets.withColumns({
        "_before": F.sum("c").over(w.orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)) - F.col("c"),
        "_n": F.sum("r").over(w),
        "_unknown": F.sum("r").over(w) - F.sum("c").over(w),
    })

    def rank(q: float):
        index = F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))
        return F.greatest(index - F.col("_unknown"), F.lit(0)) - F.col("_before")

    wanted = F.filter(
        F.array(*[F.struct(F.lit(i).alias("q"), rank(q).alias("rank")) for i, q in enumerate(qs)]),
        lambda x: (x["rank"] >= 0) & (x["rank"] < F.col("c")),
    )
    # One row per group and percentile, for the bucket its rank lies in.
    picks = ranked.filter("c > 0").select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)],
        F.col("_bucket").alias("_b"), F.inline(wanted),
    )
    on = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*by, "q").orderBy("wall_ms").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = counted.join(picks, on).withColumn("_upto", F.sum("c").over(inside)).filter(
        (F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("c"))
    )
    names = [f"p{int(q * 100)}" for q in qs]
    totals = buckets.select(*by, "r", "max", "f", F.lit(None).cast("int").alias("q"),
                            F.lit(None).cast("long").alias("wall_ms"))
    values = found.select(*by, F.lit(0).cast("long").alias("r"), F.lit(None).alias("max"),
                          F.lit(0).cast("long").alias("f"), "q", "wall_ms")
    return totals.unionByName(values).groupBy(*by).agg(
        F.sum("r").alias("n"),
        *[F.max(F.when(F.col("q") == i, F.col("wall_ms"))).alias(name)
          for i, name in enumerate(names)],
        F.max("max").alias("max"),
        F.sum("f").alias("failures"),
    )


@dataclass(frozen=True)
class Category:
    """A stack belongs to ``name`` when every group of ``all_of`` has a marker
    that occurs in one of its frames.  A marker after ``~`` ignores case."""

    name: str
    all_of: tuple[tuple[str, ...], ...]


# Phases and categories of an allocation profile, first match wins.
PHASE_MARKERS = [
    ("loop", ("bench_loop",)),
    ("warm", ("bench_warm",)),
    ("setup", (
        "bench_setup", "bench_scan_setup", "skip_heavy_workspace",
        "table_heavy_workspace", "scan_fixture_workspace", "scan_root",
        "adopt_dense_entries",
    )),
    ("warm", ("compute_diff",)),
]
SETUP_CATEGORIES = [
    Category("HashMap_insert", (("HashMap",), ("insert",))),
    Category("bench_support", (("skip_heavy_workspace", "table_heavy_workspace"),)),
    Category("scan_fixture", (("scan_fixture", "scan_root"),)),
    Category("other", ()),
]
RUN_CATEGORIES = [
    Category("push_planned", (("push_planned", "fill_planned"),)),
    Category("decide_object", (("decide_object", "diff_decide"),)),
    Category("transitions_map", (("compute_diff",), ("paths_by_table", "transitions"))),
    Category("plan_resize", (("compute_diff",), ("ensure_plan_objects", "resize_with"))),
    Category("compute_diff_schema", (("compute_diff",), ("PlannedSchema", "schema.name"))),
    Category("compute_diff_other", (("compute_diff",),)),
    Category("string_clone", (("String",), ("~clone",))),
    Category("vec_growth", (("Vec",), ("push", "with_capacity"))),
    Category("uncategorized", ()),
]


#: Marker flags in one long; more markers take more masks.
MASK_BITS = 63


def _markers(phases, categories) -> list[str]:
    found: list[str] = []
    for _, ms in phases:
        found += ms
    for cat in categories:
        for group in cat.all_of:
            found += group
    return list(dict.fromkeys(found))


def _has(marker: str):
    if marker.startswith("~"):
        return F.contains(F.lower("frame"), F.lit(marker[1:]))
    return F.contains(F.col("frame"), F.lit(marker))


def _named(totals: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame text onto rows per ``frame_id``; an index outside the frame table
    reads as ``<frame i>``."""
    return totals.join(frames, "frame_id", "left").withColumn(
        "frame", F.coalesce("frame", F.format_string("<frame %d>", F.col("frame_id")))
    )


def classify_points(
    points: DataFrame,
    frames: DataFrame,
    phases=PHASE_MARKERS,
    setup=SETUP_CATEGORIES,
    running=RUN_CATEGORIES,
) -> DataFrame:
    """Phase and category of every allocation point.

    Markers are looked up once per distinct frame, not once per stack entry;
    a point then ORs the flags of its frames.
    """
    marks = _markers(phases, setup + running)
    bits = {m: divmod(i, MASK_BITS) for i, m in enumerate(marks)}
    words = range(-(-len(marks) // MASK_BITS))

    def mask(word):
        return sum(
            (F.when(_has(m), F.lit(1 << i)).otherwise(0) for m, (w, i) in bits.items() if w == word),
            F.lit(0).cast("long"),
        )

    flagged = frames.select("frame_id", *[mask(w).cast("long").alias(f"mask{w}") for w in words])
    seen = (
        points.select("point_id", "bytes", F.explode_outer("frames").alias("frame_id"))
        .join(flagged, "frame_id", "left")
        .groupBy("point_id")
        .agg(F.first("bytes").alias("bytes"),
             *[F.coalesce(F.bit_or(f"mask{w}"), F.lit(0)).alias(f"seen{w}") for w in words])
    )

    def any_of(ms):
        found = F.lit(False)
        for word in words:
            want = sum(1 << i for m in set(ms) for w, i in [bits[m]] if w == word)
            if want:
                found = found | (F.col(f"seen{word}").bitwiseAND(F.lit(want)) != 0)
        return found

    phase = None
    for name, ms in phases:
        phase = F.when(any_of(ms), name) if phase is None else phase.when(any_of(ms), name)
    phase = phase.otherwise("setup")

    def category(cats):
        out = None
        for cat in cats:
            cond = F.lit(True)
            for group in cat.all_of:
                cond = cond & any_of(group)
            out = F.when(cond, cat.name) if out is None else out.when(cond, cat.name)
        return out

    label = F.when(F.col("phase") == "setup", category(setup)).otherwise(category(running))
    return (
        seen.withColumn("phase", phase)
        .select("point_id", "bytes", "phase", F.concat("phase", F.lit(":"), label).alias("category"))
    )


def profile_rollup(
    points: DataFrame, frames: DataFrame, iterations: int, **rules
) -> DataFrame:
    """Bytes per phase and category, per iteration, and share of the phase."""
    totals = classify_points(points, frames, **rules).groupBy("phase", "category").agg(
        F.sum("bytes").alias("bytes")
    )
    return with_share(totals).withColumn(
        "bytes_per_iteration", F.floor(F.col("bytes") / F.lit(iterations))
    )


def with_share(totals: DataFrame) -> DataFrame:
    """Percentage of the phase total; runs on rolled-up rows only."""
    whole = F.sum("bytes").over(Window.partitionBy("phase"))
    return totals.withColumn("share", F.lit(100.0) * F.col("bytes") / whole)


def short_frame(frame):
    """``symbol (location)`` without the address."""
    return F.regexp_replace(frame, r"(?s)\A0x[0-9a-f]+: (.+) \((.+)\).*\z", "$1 ($2)")


def frame_totals(
    points: DataFrame, frames: DataFrame, own_markers: list[str], entry_marker: str | None = None
) -> DataFrame:
    """Bytes per frame in three views.

    ``inclusive``: stacks an own frame occurs in, once per occurrence;
    ``deepest``: the last own frame of a stack; ``leaf``: its last frame.
    Frames of ``entry_marker`` are left out of the inclusive view.
    """
    own = F.lit(False)
    for m in own_markers:
        own = own | F.contains(F.col("frame"), F.lit(m))
    entry = F.contains(F.col("frame"), F.lit(entry_marker)) if entry_marker else F.lit(False)
    flags = frames.select("frame_id", own.alias("own"), entry.alias("entry"))
    # One pass over the stacks: an entry counts where it is own or last, and the
    # last own entry of a stack is found on the rows that are left.
    entries = (
        points.select("point_id", "bytes", (F.size("frames") - 1).alias("end"),
                      F.posexplode("frames").alias("pos", "frame_id"))
        .join(flags, "frame_id", "left")
        .withColumns({"own": F.coalesce("own", F.lit(False)), "leaf": F.col("pos") == F.col("end")})
        .filter(F.col("own") | F.col("leaf"))
    )
    last_own = F.max(F.when(F.col("own"), F.col("pos"))).over(Window.partitionBy("point_id"))
    flagged = entries.withColumn("deepest", F.col("own") & (F.col("pos") == last_own))

    def size(cond):
        return F.sum(F.when(cond, F.col("bytes")))

    # Bytes are summed per frame index first, so a frame in every stack is
    # folded map-side and texts are joined onto totals only.
    per_frame = flagged.groupBy("frame_id").agg(
        size(F.col("own") & ~F.col("entry")).alias("inclusive"),
        size(F.col("deepest")).alias("deepest"),
        size(F.col("leaf")).alias("leaf"),
    )
    views = F.array(*[
        F.struct(F.lit(name).alias("view"), F.col(name).alias("bytes"))
        for name in ("inclusive", "deepest", "leaf")
    ])
    return (
        _named(per_frame, frames)
        .select(short_frame(F.col("frame")).alias("frame"), F.inline(views))
        .filter(F.col("bytes").isNotNull())
        .groupBy("view", "frame")
        .agg(F.sum("bytes").alias("bytes"))
    )


def top_frames(totals: DataFrame, k: int = 15) -> DataFrame:
    """The heaviest frames of a report; ties by name."""
    return totals.orderBy(F.desc("bytes"), "frame").limit(k)


def timing_report(runs: DataFrame, base: str = "baseline", actual: str = "actual") -> DataFrame:
    """Two runs side by side per scenario and phase, with the delta text."""
    def side(name):
        return F.sum(F.when(F.col("run") == name, F.col("ms")))

    wide = runs.filter(F.col("run").isin(base, actual)).groupBy("scenario", "phase").agg(
        side(base).alias("baseline_ms"), side(actual).alias("actual_ms")
    )
    return wide.withColumn(
        "delta", text.delta_ms_text(F.col("baseline_ms"), F.col("actual_ms"))
    )


def timing_history(runs: DataFrame, order: str = "run") -> DataFrame:
    """Each run against the one before it, for more than two runs.  ``order``
    is a run number; one scenario may have any number of runs."""
    blocked = runs.withColumn("_block", F.floor(F.col(order) / BLOCK))
    return (
        previous(blocked, ["scenario", "phase"], "_block", order, "ms", "previous_ms")
        .drop("_block")
        .withColumn("delta", text.delta_ms_text(F.col("previous_ms"), F.col("ms")))
    )
