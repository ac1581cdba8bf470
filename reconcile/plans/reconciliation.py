"""The full plan: what must happen to every managed object, and why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from reconcile import KEY
from reconcile.functions import scenarios as sc
from reconcile.functions.checksums import present
from reconcile.operators import catalog as ct, drift as dr, history as hs, transitions as tr

PLAN_COLUMNS = [
    *KEY, "object_path", "schema_name", "kind", "object_name", "parent_name", "exists",
    "checksum", "prior", "drift", "transitions", "scenario", "planned_action", "counter",
    "blocked", "needs_provenance", "message",
]


def resolve_scenario(joined: DataFrame) -> DataFrame:
    """Scenario and its attributes on rows that carry all facts."""
    scenario = sc.scenario_of(
        exists=F.col("exists"),
        prior=F.col("prior"),
        checksum=F.col("checksum"),
        drift=F.coalesce("drift", F.lit(False)),
        kind=F.col("kind"),
        transitions=F.coalesce("transitions", F.lit(0)),
        parent_name=F.col("parent_name"),
        parent_managed=F.col("parent_managed"),
        parent_exists=F.col("parent_exists"),
        parent_prior=F.col("parent_prior"),
    )
    return scenario_attrs(joined.withColumn("scenario", scenario))


def scenario_attrs(df: DataFrame) -> DataFrame:
    s = F.col("scenario")
    label = F.col("parent_label") if "parent_label" in df.columns else F.lit(None).cast("string")
    return df.withColumns({
        "planned_action": sc.action_of(s),
        "counter": sc.counter_of(s),
        "blocked": sc.is_blocked(s),
        "needs_provenance": sc.needs_provenance(s),
        "message": sc.blocker_message(s, F.col("normalized_key"), label),
    })


def compute_plan(
    manifest: DataFrame,
    catalog: DataFrame,
    history: DataFrame | None,
    object_ddl: DataFrame,
    transitions: DataFrame,
    live: DataFrame | Callable[[DataFrame], DataFrame],
    force_full: bool = False,
    latest: DataFrame | None = None,
    repair: bool = False,
) -> DataFrame:
    """Plan rows for all databases at once.

    Every input is shuffled once on the key, after map-side aggregation where
    it has many rows per key, and all joins share that partitioning.  ``live``
    gives ``live_checksum`` per key, or is called with the suspect keys so that
    only those are fingerprinted.  ``latest`` replaces the pass over the log
    where a maintained state of it exists (``streaming.tail``).

    A managed key whose recorded checksum cannot be decoded fails the plan, or
    counts as never recorded when ``repair`` is set.
    """
    if latest is None:
        latest = hs.latest_object_history(history)
    flagged = dr.suspects(latest, object_ddl, force_full)
    live_rows = live(dr.suspect_keys(flagged)) if callable(live) else live
    drifted = dr.drift(flagged, live_rows).select(*KEY, "checksum", "drift")

    facts = ct.catalog_facts(catalog)
    known = ct.with_exists(manifest, facts)
    tables = ct.with_prior(known.filter(F.col("kind") == "tables"), latest)
    # Only triggers look up a parent, so only they travel to its partition.
    parents = ct.parent_facts(known.filter(F.col("kind") == "triggers"), tables)

    # Decoded after the join, so log rows of unmanaged keys cannot fail the plan.
    recorded = hs.decoded(F.col("_recorded"), repair)
    rows = (
        known.join(drifted.withColumnRenamed("checksum", "_recorded"), KEY, "left")
        .withColumn("_recorded", F.when(F.col("_recorded").isNotNull(), recorded))
        .withColumn("prior", F.when(present(F.col("_recorded")), F.col("_recorded")))
        .join(tr.transition_counts(transitions), KEY, "left")
        .join(parents, KEY, "left")
        .withColumns({
            "transitions": F.coalesce("transitions", F.lit(0)),
            "drift": F.coalesce("drift", F.lit(False)),
            "parent_managed": F.coalesce("parent_managed", F.lit(False)),
        })
    )
    return resolve_scenario(rows).select(*PLAN_COLUMNS)
