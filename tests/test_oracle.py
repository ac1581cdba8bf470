"""Every registered query agrees with its oracle SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from workload import check, registry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem = check.compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    # A few ladder rungs do not occur in the smallest data.
    assert problem in (None, "both empty"), problem


def test_entry_is_the_plan(spark):
    df = entry.entry(spark)
    assert {"scenario", "planned_action", "message"} <= set(df.columns)
    assert df.count() == 200


def test_flagship_counts(spark):
    """Counts recorded with the fixtures for sf0.01."""
    got = {r.scenario: r.n for r in QUERIES["flagship_plan"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {
        "adopt": 79, "create": 100, "live_structural_drift_blocked": 42, "module_update": 74,
        "skip_unchanged": 638, "structural_change_blocked": 40,
        "table_blocked_no_transitions": 1, "table_reprocess": 16,
        "trigger_blocked_parent_missing": 2, "trigger_update_module": 8,
    }


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(registry.QUERIES) == set(registry.ORACLE)
