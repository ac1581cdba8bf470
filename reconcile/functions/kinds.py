"""Object kinds: codes, deploy ranks, catalog labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Managed kinds in deploy order (rank = position, code = rank + 1).
MANAGED_KINDS = [
    "types", "sequences", "tables", "synonyms", "indexes",
    "views", "functions", "procedures", "triggers",
]
MODULE_KINDS = ["views", "functions", "procedures", "triggers"]
TRANSACTIONAL_KINDS = ["tables", "indexes", "types", "sequences", "synonyms"]
UNKNOWN_RANK = 99

# Catalog type label to kind folder.
TYPE_LABELS = {
    "user_table": "tables",
    "view": "views",
    "sql_stored_procedure": "procedures",
    "sql_scalar_function": "functions",
    "sql_table_valued_function": "functions",
    "sql_inline_table_valued_function": "functions",
    "sql_trigger": "triggers",
    "service_queue": "queues",
    "synonym": "synonyms",
    "sequence_object": "sequences",
}


def lookup(col: Column, mapping: dict) -> Column:
    """Constant map lookup; NULL for an absent key."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col)


def kind_from_type_desc(col: Column) -> Column:
    low = F.lower(col)
    return F.coalesce(lookup(low, TYPE_LABELS), low)


def kind_code(kind: Column) -> Column:
    codes = {k: i + 1 for i, k in enumerate(MANAGED_KINDS)}
    return F.coalesce(lookup(kind, codes), F.lit(0))


def kind_rank(kind: Column) -> Column:
    ranks = {k: i for i, k in enumerate(MANAGED_KINDS)}
    return F.coalesce(lookup(kind, ranks), F.lit(UNKNOWN_RANK))


def is_managed(kind: Column) -> Column:
    return kind.isin(MANAGED_KINDS)


def is_module(kind: Column) -> Column:
    return kind.isin(MODULE_KINDS)


def is_transactional(kind: Column) -> Column:
    return kind.isin(TRANSACTIONAL_KINDS)
