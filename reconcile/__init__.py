"""State reconciliation over tables, as Spark DataFrame operators.

Desired state (``manifest``), actual state (``catalog``), last applied state
(``history``) and the change signal (``object_ddl``) are plain DataFrames keyed
by ``(database_name, normalized_key)``.  Every operator takes DataFrames and
returns a lazy DataFrame, so whole plans stay one Catalyst query.
"""

KEY = ["database_name", "normalized_key"]
