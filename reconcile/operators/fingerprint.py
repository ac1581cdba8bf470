"""Canonical state of objects and its fingerprint.

An object's state is a JSON object: its own attributes plus one ordered child
list per child table (columns, checks, keys, ...).  Child lists are built in
chunks of consecutive ordinals, so one object with very many children never
gathers its raw rows in one task.  In the state a list is its row count and the
digests of its chunks; the chunks themselves are rows (:func:`child_chunks`).

Entries may hold lists of their own (the columns of a key, say), to any depth.  They
are folded from the bottom up: the digests of an inner list go to the chunk of the entry
they belong to and meet it there by its ordinal, so no level ever gathers rows of another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from reconcile import KEY

CHUNK = 4096
_JSON = {"ignoreNullFields": "false"}


def fingerprint(kind: Column, state: Column) -> Column:
    """SHA-256 of ``kind:state``; NULL without a state."""
    return F.sha2(F.concat(kind, F.lit(":"), F.nullif(state, F.lit(""))), 256)


class ChildList(NamedTuple):
    """One list of an object: its rows, their order column and their columns.

    ``lists`` are lists inside each entry.  Their rows carry the object's key and
    the order column of every list around them.  ``where`` picks the list's rows out
    of ``rows``, None takes all; lists that differ only in it are folded in one pass.
    """

    rows: DataFrame
    order: str
    columns: list[str]
    lists: dict[str, ChildList | tuple] = {}
    where: Column | None = None


def _object_json(attributes: Column, lists: dict[str, Column]) -> Column:
    """``attributes``, a JSON object, continued by the values of ``lists``, null where NULL."""
    if not lists:
        return attributes
    # The object loses its closing brace and is continued.
    head = attributes.substr(F.lit(1), F.length(attributes) - 1)
    more = [F.concat(F.lit(f'"{n}":'), F.coalesce(_list_json(c), F.lit("null"))) for n, c in lists.items()]
    sep = F.when(F.length(attributes) > 2, ",").otherwise("")
    return F.concat(head, sep, F.concat_ws(",", *more), F.lit("}"))


def _list_json(folded: Column) -> Column:
    """JSON value of a list :func:`_fold` made."""
    digests = F.transform(folded["ds"], lambda d: F.lower(F.hex(d)))
    return F.concat(
        F.lit('{"rows":'), folded["n"].cast("string"), F.lit(',"chunks":["'),
        F.array_join(digests, '","'), F.lit('"]}'),
    )


def _passes(
    lists: dict[str, ChildList | tuple], chunk: int, by: list[str],
) -> Iterator[tuple[list[str], DataFrame]]:
    """The names of lists that are folded together, and their fold."""
    alike: dict[tuple, dict[str, ChildList]] = {}
    for name, child in lists.items():
        c = ChildList(*child)
        alike.setdefault((name,) if c.lists else ("", id(c.rows), c.order, *c.columns), {})[name] = c
    for same in alike.values():
        c = next(iter(same.values()))
        where = {name: x.where for name, x in same.items()}
        yield list(same), _fold(c.rows, c.order, c.columns, chunk, c.lists, by, where)


def _checked(child: DataFrame, by_chunk: list[str], where: dict[str, Column | None]) -> DataFrame:
    """Rows of lists without inner lists with ``unique``: no other row of a list has the ordinal."""
    # The window's exchange, which is left out where rows already lie by some of its
    # columns, serves the grouping too; a key's chunks go to different tasks.
    w, span = Window.partitionBy(*by_chunk).orderBy("_o"), (Window.unboundedPreceding, Window.currentRow)
    alone = []
    for row in [F.lit(True)] if any(x is None for x in where.values()) else [F.col("_in")[n] for n in where]:
        # Up to the last equal ordinal there are as many rows as up to this row.
        rows = F.count(F.when(row, 1))
        alone.append(~row | (rows.over(w.rowsBetween(*span)) == rows.over(w.rangeBetween(*span))))
    return child.withColumn("unique", reduce(and_, alone))


def _met(
    child: DataFrame, order: str, chunk_no: Column, lists: dict[str, ChildList | tuple],
    chunk: int, by: list[str],
) -> DataFrame:
    """Rows with the folded lists inside them and ``unique``.

    Rows and folds travel once, to the chunk the row belongs to, and meet there by
    ordinal: a join would need an exchange of both by ordinal before.
    """
    types = dict(child.select(*by, F.col("_o").alias(order)).dtypes)
    names = {n: f"_list_{n}" for n in lists}
    for own, fold in _passes(lists, chunk, [*by, order]):
        have = dict(fold.dtypes)
        at = [F.col(c) if have[c] == t else F.col(c).try_cast(t).alias(c) for c, t in types.items()]
        # A NULL in what a list belongs to is equal to no row's.
        fold = fold.select(*at, *[F.col(n).alias(names[n]) for n in own]).dropna(subset=list(types))
        fold = fold.select(*by, chunk_no.alias("chunk_no"), F.col(order).alias("_o"), *[names[n] for n in own])
        child = child.unionByName(fold, allowMissingColumns=True)
    by_chunk = [*by, "chunk_no"]
    return child.repartition(*by_chunk).groupBy(*by_chunk, "_o").agg(
        F.first("_r", True).alias("_r"), F.count("_r").alias("copies"),
        *[F.first(c, True).alias(c) for c in names.values()],
    ).filter("copies > 0").withColumn("unique", F.col("copies") == 1)


def _chunks(
    child: DataFrame, order: str, columns: list[str], chunk: int,
    lists: dict[str, ChildList | tuple] | None, by: list[str], where: dict[str, Column | None],
) -> DataFrame:
    """Per ``by`` and ``chunk_no`` each list's ``n`` and ``json`` as a struct; ``where`` names the lists."""
    by_chunk = [*by, "chunk_no"]
    some = {n: w for n, w in where.items() if w is not None}
    if len(some) == len(where):
        child = child.filter(reduce(or_, some.values()))
    if len(where) == 1:
        some = {}
    chunk_no = F.floor(F.col(order) / chunk)
    picked = [F.struct(*[F.coalesce(w, F.lit(False)).alias(n) for n, w in some.items()]).alias("_in")] if some else []
    placed = child.select(
        *by, chunk_no.alias("chunk_no"), F.col(order).alias("_o"), F.struct(*columns).alias("_r"), *picked
    )
    if lists:
        placed = _met(placed, order, chunk_no, lists, chunk, by)
        # Digests become text only here, behind the exchange.
        text = _object_json(F.col("_r"), {n: F.col(f"_list_{n}") for n in lists})
        placed = placed.withColumn("_r", F.to_json("_r", _JSON)).withColumn("_r", text)
    else:
        placed = _checked(placed, by_chunk, where if some else {"": None})
    unique = F.when(F.col("unique"), F.col("_o")).otherwise(
        F.raise_error(F.lit("child ordinals are not unique")).cast("bigint")
    )
    row = F.struct(unique.alias("_o"), "_r", *(["_in"] if some else []))
    gathered = placed.select(*by_chunk, row.alias("row")).groupBy(*by_chunk).agg(
        F.sort_array(F.collect_list("row")).alias("rows")
    )

    def value(n: str) -> Column:
        rows = F.filter("rows", lambda r: r["_in"][n]) if n in some else F.col("rows")
        entries = F.transform(rows, lambda r: r["_r"])
        text = F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]")) if lists else F.to_json(entries, _JSON)
        return F.struct(F.size(rows).cast("long").alias("n"), text.alias("json"))

    return gathered.select(*by_chunk, *[value(n).alias(n) for n in where])


def _fold(
    child: DataFrame, order: str, columns: list[str], chunk: int,
    lists: dict[str, ChildList | tuple] | None, by: list[str], where: dict[str, Column | None],
) -> DataFrame:
    """Per ``by`` each list as its row count ``n`` and its chunks' digests ``ds`` in order, NULL without rows.

    Digests travel as bytes, half the size of their text.
    """
    digest = lambda c: F.when(c["n"] > 0, F.struct("chunk_no", F.unhex(F.sha2(c["json"], 256)).alias("d")))
    chunks = _chunks(child, order, columns, chunk, lists, by, where)
    ns, ds = {n: f"_n_{n}" for n in where}, {n: f"_d_{n}" for n in where}
    digests = chunks.select(*by, *[c for n in where for c in (
        F.col(n)["n"].alias(ns[n]), digest(F.col(n)).alias(ds[n]))])
    sums = digests.groupBy(*by).agg(*[c for n in where for c in (
        F.sum(ns[n]).alias(ns[n]), F.sort_array(F.collect_list(ds[n])).alias(ds[n]))])
    value = lambda n: F.struct(F.col(ns[n]).alias("n"), F.transform(ds[n], lambda d: d["d"]).alias("ds"))
    return sums.select(*by, *[F.when(F.col(ns[n]) > 0, value(n)).alias(n) for n in where])


def child_chunks(
    child: DataFrame, order: str, columns: list[str], chunk: int = CHUNK,
    lists: dict[str, ChildList | tuple] | None = None, by: list[str] = KEY,
) -> DataFrame:
    """Readable form of child lists: per key and ``chunk_no`` the rows' ordered JSON array.

    ``order`` must be a whole number that is unique within a key, as column,
    partition and key ordinals are; a chunk then holds at most ``chunk`` rows.
    Repeated ordinals fail the job before any list is built.  ``by`` are the columns
    a list belongs to: the key, and the ordinals of the lists around it.
    """
    return _chunks(child, order, columns, chunk, lists, by, {"_c": None}).select(*by, "chunk_no", "_c.n", "_c.json")


def child_list(
    child: DataFrame, name: str, order: str, columns: list[str], chunk: int = CHUNK,
    lists: dict[str, ChildList | tuple] | None = None, by: list[str] = KEY,
) -> DataFrame:
    """One JSON value per key: row count and the digests of :func:`child_chunks` in order.

    The form is the same whatever the length of the list.
    """
    folded = _fold(child, order, columns, chunk, lists, by, {name: None})
    return folded.select(*by, _list_json(F.col(name)).alias(name))


def canonical_state(
    objects: DataFrame,
    attributes: list[str],
    children: dict[str, ChildList | tuple],
    chunk: int = CHUNK,
) -> DataFrame:
    """``objects`` (keys, ``kind``, attributes) with ``state`` and ``live_checksum``.

    ``children`` maps a list name to its :class:`ChildList`, or to the tuple of its
    fields.  A missing child list is NULL in the JSON, as are NULL attributes, at
    every level.  All joins use the partitioning by key the lists come in.
    """
    out = objects.select(*KEY, "kind", F.to_json(F.struct(*attributes), _JSON).alias("_attrs"))
    for _, lists in _passes(children, chunk, KEY):
        out = out.join(lists, KEY, "left")
    state = _object_json(F.col("_attrs"), {n: F.col(n) for n in children})
    return out.select(*KEY, "kind", state.alias("state")).withColumn(
        "live_checksum", fingerprint(F.col("kind"), F.col("state"))
    )


def text_state(modules: DataFrame, definition: str) -> DataFrame:
    """State of kinds that are their own text: module bodies, synonym targets."""
    return modules.select(*KEY, "kind", F.col(definition).alias("state")).withColumn(
        "live_checksum", fingerprint(F.col("kind"), F.col("state"))
    )
