"""Connected components of links between nodes, by repeated contraction.

Each pass points every node at its smallest neighbour or itself and replaces the
links by those between the targets. All nodes with a smaller neighbour vanish,
so few passes remain even for long chains. Links and labels of each pass are
tables below the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcile.session import work_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below the shared folder."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    # with the schema given, Spark needn't open a file to learn it
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """``df`` in a few tasks for each core of the cluster at most, for tables that a round writes and
    the next ones read: with many more tasks the files and not the rows would take the time."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def free(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b); component is the smallest node.

    Self links give a component of one; no links, no rows.
    """
    # both ways from one reading of the links, which may be a join
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.select(F.explode(ways).alias("way")).select("way.a", "way.b").distinct()
    edges = written(gathered(both), "edges")
    labels = None
    while not edges.isEmpty():
        to = written(gathered(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))), "targets")
        if labels is None:
            labels = to.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            moved = to.select(F.col("a").alias("component"), "to")
            labels = written(
                gathered(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))),
                "labels",
            )
        ends = to.select(F.col("a").alias("b"), F.col("to").alias("b_to"))
        edges = written(
            gathered(
                edges.join(to, "a").select(F.col("to").alias("a"), "b").distinct()
                .join(ends, "b").select("a", F.col("b_to").alias("b")).where("a <> b").distinct()
            ),
            "edges",
        )
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
