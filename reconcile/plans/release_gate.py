"""Release gate: changed paths to delta, snapshot comparison to verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reconcile.operators import gate, scope


def release_gate(
    base: DataFrame,
    cur: DataFrame,
    manifest: DataFrame,
    transitions: DataFrame,
    catalog: DataFrame,
    changed: DataFrame,
    *,
    versions: tuple[str, str] = (gate.SNAPSHOT_VERSION, gate.SNAPSHOT_VERSION),
    blocked: tuple[bool, bool] = (False, False),
    **verdict,
) -> tuple[DataFrame, DataFrame]:
    """(problems, verdict) of a candidate snapshot against its baseline.

    ``versions`` and ``blocked`` are those of the two snapshots' headers
    (baseline, current).
    """
    keys = scope.keys_for_changed_paths(manifest, transitions, changed)
    delta = scope.expand_delta(keys, manifest, catalog)
    problems = gate.compare_snapshots(base, cur, delta, versions=versions, blocked=blocked)
    return problems, gate.evaluate_gate(problems, delta, blocked=blocked[1], **verdict)
