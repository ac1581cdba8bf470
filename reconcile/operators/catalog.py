"""Operators between the manifest and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reconcile import KEY
from reconcile.functions import paths, text
from reconcile.functions.checksums import present
from reconcile.operators.skew import spread_join

SCOPE = ["database_name", "schema_name", "kind", "object_name"]


def _lower_keys(df: DataFrame) -> DataFrame:
    for c in ("schema_name", "kind", "object_name"):
        df = df.withColumn(c, F.lower(c))
    return df


def scoped_catalog(catalog: DataFrame, scope: DataFrame) -> DataFrame:
    """Object rows in ``scope`` plus the schema rows the scope lives in.

    Rows with a true ``is_shipped`` belong to the server itself and stay out.
    """
    rows = _lower_keys(catalog)
    if "is_shipped" in rows.columns:
        rows = rows.filter(~F.coalesce("is_shipped", F.lit(False)))
    wanted = _lower_keys(scope.select(*SCOPE))
    objects = rows.filter(F.col("row_kind") == "object").join(wanted, SCOPE, "left_semi")
    schemas = rows.filter(F.col("row_kind") == "schema").join(
        wanted.select("database_name", "schema_name").distinct(),
        ["database_name", "schema_name"],
        "left_semi",
    )
    return objects.unionByName(schemas)


def catalog_parents(objects: DataFrame, spread: bool = False) -> DataFrame:
    """``parent_name`` from ``parent_object_id`` within one database; blank when none.

    ``spread`` cuts the children of parents that hold very many of them.
    """
    parents = objects.select(
        "database_name",
        F.col("object_id").alias("parent_object_id"),
        F.lower("object_name").alias("parent_name"),
    )
    # Most objects have no parent; they take no part in the join.
    children = objects.filter(F.col("parent_object_id").isNotNull())
    join = spread_join if spread else DataFrame.join
    found = join(children, parents, ["database_name", "parent_object_id"], "left")
    roots = objects.filter(F.col("parent_object_id").isNull()).withColumn(
        "parent_name", F.lit(None).cast("string")
    )
    return found.unionByName(roots).withColumn(
        "parent_name", F.coalesce("parent_name", F.lit(""))
    )


def union_catalog(parts: dict[str, DataFrame], kinds: list[str]) -> DataFrame:
    """Union of ``schemas``, ``objects``, ``types`` and ``indexes`` rows.  A
    branch no kind of the scope needs is left out of the plan altogether."""
    wanted = ["schemas"] if "schemas" in parts else []
    if any(k not in ("types", "indexes") for k in kinds):
        wanted.append("objects")
    wanted += [k for k in ("types", "indexes") if k in kinds]
    out = None
    for name in wanted:
        if name in parts:
            out = parts[name] if out is None else out.unionByName(parts[name])
    if out is None:
        raise ValueError("no catalog branch matches the given kinds")
    return out


def merge_stable(loaded: DataFrame, stable: DataFrame) -> DataFrame:
    """Freshly loaded rows win, stable rows fill the gaps."""
    gaps = stable.join(loaded.select(*KEY), KEY, "left_anti")
    return loaded.unionByName(gaps)


def hydrate_parents(snapshot: DataFrame, live_indexes: DataFrame) -> DataFrame:
    """Fill blank parents of index rows from live (schema, index, parent) rows."""
    live = live_indexes.filter(F.col("parent_name") != "").groupBy(
        F.col("database_name").alias("_d"),
        F.lower("schema_name").alias("_s"),
        F.lower("object_name").alias("_o"),
    ).agg(F.min("parent_name").alias("_live"))
    on = (
        (F.col("database_name") == F.col("_d"))
        & (F.lower("schema_name") == F.col("_s"))
        & (F.lower("object_name") == F.col("_o"))
        & (F.col("kind") == "indexes")
    )
    return snapshot.join(live, on, "left").withColumn(
        "parent_name", F.coalesce(F.nullif(F.col("parent_name"), F.lit("")), "_live")
    ).drop("_d", "_s", "_o", "_live")


def catalog_facts(catalog: DataFrame) -> DataFrame:
    """One row per catalog key with the struct ``fact`` (``parent_name``, NULL
    when it has none).

    The struct is a single aggregate, so plans that need presence only and
    plans that need the parent share one shuffle of the catalog.
    """
    parent = F.nullif(F.col("parent_name"), F.lit("")).alias("parent_name")
    return catalog.groupBy(*KEY).agg(F.max(F.struct(parent)).alias("fact"))


def with_exists(manifest: DataFrame, facts: DataFrame) -> DataFrame:
    """Manifest rows with ``exists`` and the catalog's ``parent_name``."""
    return manifest.join(facts, KEY, "left").withColumns({
        "exists": F.col("fact").isNotNull(),
        "parent_name": F.col("fact.parent_name"),
    }).drop("fact")


def with_prior(rows: DataFrame, latest: DataFrame) -> DataFrame:
    """``prior``: recorded checksum, NULL when none is really recorded."""
    prior = F.when(present(F.col("checksum")), F.col("checksum")).alias("prior")
    return rows.join(latest.select(*KEY, prior), KEY, "left")


def parent_facts(asks: DataFrame, tables: DataFrame, spread: bool = False) -> DataFrame:
    """Facts about the parent of every child in ``asks`` (keys, ``parent_name``).

    The parent is a managed table in the child's own schema.  ``tables`` are
    manifest rows with ``exists`` and ``prior``.  Children without a managed
    parent get no row.  ``spread`` cuts the children of parents that hold very many.
    """
    parent = tables.filter(F.col("kind") == "tables").select(
        "database_name",
        F.col("normalized_key").alias("_want"),
        F.lit(True).alias("parent_managed"),
        F.col("exists").alias("parent_exists"),
        F.col("prior").alias("parent_prior"),
        F.col("object_name").alias("parent_label"),
    )
    schema = paths.split_key(F.col("normalized_key"))["schema_name"]
    want = paths.normalized_key(schema, F.lit("tables"), F.col("parent_name"))
    named = asks.filter(F.coalesce("parent_name", F.lit("")) != "").select(
        *KEY, want.alias("_want")
    )
    join = spread_join if spread else DataFrame.join
    return join(named, parent, ["database_name", "_want"], "inner").drop("_want")


def with_parent(rows: DataFrame, tables: DataFrame, spread: bool = False) -> DataFrame:
    """``rows`` with facts about their parent table.

    Rows without a parent name take no part in the parent lookup.
    ``parent_name`` is kept: named but unmatched is not unnamed.
    """
    found = parent_facts(rows.select(*KEY, "parent_name"), tables, spread)
    return rows.join(found, KEY, "left").withColumn(
        "parent_managed", F.coalesce("parent_managed", F.lit(False))
    )


def table_columns(columns: DataFrame, manifest: DataFrame) -> DataFrame:
    """Column rows of managed tables, lower-cased and keyed."""
    key = paths.normalized_key(F.col("schema_name"), F.lit("tables"), F.col("table_name"))
    keyed = columns.withColumn("normalized_key", key)
    tables = manifest.filter(F.col("kind") == "tables").select(*KEY)
    return keyed.join(tables, KEY, "left_semi").select(
        *KEY,
        F.lower("column_name").alias("column_name"),
        F.lower("type_name").alias("type_name"),
        text.decode_nullable(F.col("is_nullable").cast("string")).alias("nullable"),
    )


def column_lists(columns: DataFrame) -> DataFrame:
    """Per table the ordered list of (name, type, nullable).  A list is as long as
    its table is wide; repeats of a name fold before it is built."""
    once = columns.groupBy(*KEY, "column_name").agg(
        F.min("type_name").alias("type_name"), F.min("nullable").alias("nullable")
    )
    item = F.struct("column_name", "type_name", "nullable")
    return once.groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias("columns"))


def ownership(manifest: DataFrame, catalog: DataFrame, history: DataFrame) -> DataFrame:
    """managed / unmanaged / orphaned per key.  Absence from the manifest is
    reported and never turned into a destructive action."""
    m = manifest.select(*KEY, F.lit(True).alias("_m"))
    c = catalog.select(*KEY).distinct().select(*KEY, F.lit(True).alias("_c"))
    h = history.select(*KEY).distinct().select(*KEY, F.lit(True).alias("_h"))
    status = (
        F.when(F.col("_m"), "managed")
        .when(F.col("_h"), "orphaned")
        .otherwise("unmanaged")
    )
    return (
        m.join(c, KEY, "full_outer")
        .join(h, KEY, "left")
        .select(
            *KEY,
            status.alias("ownership"),
            F.coalesce("_c", F.lit(False)).alias("exists"),
            F.lit("none").alias("destructive_action"),
        )
    )


def schema_actions(manifest: DataFrame, catalog_schemas: DataFrame) -> DataFrame:
    """``exists`` or ``create_schema`` for every (database, schema) of the layout."""
    on = ["database_name", "schema_name"]
    wanted = manifest.select("database_name", F.lower("schema_name").alias("schema_name"))
    have = catalog_schemas.select(
        "database_name", F.lower("schema_name").alias("schema_name")
    ).distinct().withColumn("_have", F.lit(True))
    return wanted.distinct().join(have, on, "left").select(
        *on,
        F.when(F.col("_have"), "exists").otherwise("create_schema").alias("action"),
    )


def kinds_in_scope(manifest: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Distinct kinds a scope touches; the whole manifest without a scope."""
    rows = manifest if scope is None else manifest.join(scope.select(*KEY), KEY, "left_semi")
    return rows.select("kind").distinct()


def for_database(tables: dict[str, DataFrame], database: str) -> dict[str, DataFrame]:
    """Every table cut down to one database; prunes partitions by database."""
    return {
        n: df.filter(F.col("database_name") == database) for n, df in tables.items()
    }


def provable_empty(kinds: list[str]) -> bool:
    """Whether an empty object probe proves an empty scope: type and index rows
    live in other tables than plain objects."""
    return not any(k in ("types", "indexes") for k in kinds)
