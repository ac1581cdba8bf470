"""The data side of executing a plan: what runs, in which order, what is recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reconcile.operators import history as hs, products as pr, transitions as tr


def prepare_execution(
    plan: DataFrame, transitions: DataFrame, history: DataFrame, allow_adopt: bool = False
) -> dict[str, DataFrame]:
    """Lazy frames a run needs: refused adoptions, tampered and pending change
    scripts, objects in deploy order, and the audit rows to append afterwards."""
    log = hs.latest_migrations(history)
    linked = tr.link_transitions(transitions, plan).select(transitions.columns)
    return {
        "refused_adoptions": pr.adoption_gate(plan, allow_adopt),
        "tampered": tr.tampered_transitions(plan, linked, log),
        "pending": tr.pending_transitions(plan, linked, log),
        "deploy": pr.deploy_order(plan),
        "records": tr.creation_records(plan, linked),
    }
