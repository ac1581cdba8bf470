"""Scenarios, actions and their attributes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .checksums import present
from .kinds import is_managed, is_module, lookup

# Scenario to planned action.
ACTIONS = {
    "create": "create_object",
    "adopt": "adopt_existing",
    "skip_unchanged": "skip_unchanged",
    "table_reprocess": "reprocess_changed",
    "table_blocked_no_transitions": "reprocess_changed_blocked",
    "trigger_update_module": "update_existing_module",
    "trigger_blocked_parent_missing": "reprocess_changed_blocked",
    "trigger_blocked_parent_changing": "reprocess_changed_blocked",
    "module_update": "update_existing_module",
    "structural_change_blocked": "fail",
    "live_structural_drift_blocked": "fail",
}
BLOCKED = [
    "table_blocked_no_transitions", "structural_change_blocked",
    "live_structural_drift_blocked", "trigger_blocked_parent_missing",
    "trigger_blocked_parent_changing",
]
COUNTERS = {"create": "create", "adopt": "adopt", "skip_unchanged": "skip"}
RISKY_ACTIONS = ["fail", "reprocess_changed_blocked"]


def action_of(scenario: Column) -> Column:
    return lookup(scenario, ACTIONS)


def counter_of(scenario: Column) -> Column:
    return F.coalesce(lookup(scenario, COUNTERS), F.lit("changed"))


def is_blocked(scenario: Column) -> Column:
    return scenario.isin(BLOCKED)


def needs_provenance(scenario: Column) -> Column:
    return scenario != "skip_unchanged"


def drift_flag(
    kind: Column, checksum: Column, recorded: Column, suspect: Column, live: Column
) -> Column:
    """Live state differs from what the audit log recorded.  The rung order
    matters: a missing fingerprint is drift even for a row that is no suspect."""
    return (
        F.when(~is_managed(kind), False)
        .when(checksum.isNull() | (F.length(checksum) != 64), False)
        .when(~present(checksum), False)
        .when(recorded.isNull(), True)
        .when(~suspect, False)
        .when(live.isNull(), True)
        .otherwise(recorded != live)
    )


def scenario_of(
    *,
    exists: Column,
    prior: Column,
    checksum: Column,
    drift: Column,
    kind: Column,
    transitions: Column,
    parent_name: Column,
    parent_managed: Column,
    parent_exists: Column,
    parent_prior: Column,
) -> Column:
    """One explained outcome per object, first matching rung wins."""
    module = is_module(kind)
    has_parent = F.coalesce(parent_name != "", F.lit(False))
    parent_live = F.coalesce(parent_managed & parent_exists, F.lit(False))
    trigger = (
        F.when(~has_parent, "module_update")
        .when(~parent_live, "trigger_blocked_parent_missing")
        .when(~present(parent_prior), "trigger_blocked_parent_changing")
        .otherwise("trigger_update_module")
    )
    table = F.when(transitions > 0, "table_reprocess").otherwise(
        "table_blocked_no_transitions"
    )
    return (
        F.when(~exists, "create")
        .when(~present(prior), "adopt")
        .when(drift & module, "module_update")
        .when(drift, "live_structural_drift_blocked")
        .when(prior == checksum, "skip_unchanged")
        .when(kind == "tables", table)
        .when(kind == "triggers", trigger)
        .when(module, "module_update")
        .otherwise("structural_change_blocked")
    )


def blocker_message(scenario: Column, key: Column, parent_label: Column) -> Column:
    """Text for a blocked scenario, NULL otherwise."""
    label = F.coalesce(parent_label, F.lit("?"))

    def fmt(pattern: str, *cols: Column) -> Column:
        return F.format_string(pattern, *cols)

    return (
        F.when(
            scenario == "table_blocked_no_transitions",
            fmt("table %s changed but has no non-scaffold transition scripts", key),
        )
        .when(
            scenario == "structural_change_blocked",
            fmt("%s changed but this object kind has no safe in-place update path", key),
        )
        .when(
            scenario == "live_structural_drift_blocked",
            fmt("live %s differs from its last audited structural state", key),
        )
        .when(
            scenario == "trigger_blocked_parent_missing",
            fmt("trigger %s parent table %s not found", key, label),
        )
        .when(
            scenario == "trigger_blocked_parent_changing",
            fmt("trigger %s parent table %s is changing", key, label),
        )
    )
