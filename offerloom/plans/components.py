"""Connected components of a table of links by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.plans.checkpoints import materialize
from offerloom.plans.joins import is_small, lookup_join


def _parents(links: DataFrame, turn: int) -> DataFrame:
    """Every node of links(a, b) with the first of itself and its neighbours, in an order new in each turn."""
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def place(column: str) -> Column:
        return F.struct(F.xxhash64(column, F.lit(turn)).alias("at"), F.col(column).alias("parent"))

    first = ends.groupBy("a").agg(F.min(place("b")).alias("first"))
    return first.select(F.col("a").alias("node"), F.least("first", place("a"))["parent"].alias("parent"))


def _moved(table: DataFrame, column: str, parents: DataFrame, small: bool) -> DataFrame:
    """The table with the nodes of a column replaced by their parents, where they have one."""
    keyed = parents.withColumnRenamed("node", column)
    moved = table.join(F.broadcast(keyed), column, "left") if small else lookup_join(table, keyed, [column], "left")
    return moved.withColumn(column, F.coalesce("parent", column)).select(*table.columns)


def _once(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def contracted_labels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, component)`` for nodes(node) under links(a, b), all of type bigint.

    Nodes of one component, and only those, share the number.  Every round merges
    each node into one neighbour and drops links within a node, until none is
    left.  The order is by hash, another one each time, so that along any path a
    round removes a constant share of the nodes, and a star goes in two.  A
    neighbourhood is never gathered: its minimum is a partial aggregate, joined
    back with frequent nodes apart.
    """
    links, turn = materialize(_once(links)), 0
    labels = nodes.select("node", F.col("node").alias("component"))
    while not links.isEmpty():
        parents = materialize(_parents(links, turn))
        small = is_small(parents)
        labels = materialize(_moved(labels, "component", parents, small))
        links = materialize(_once(_moved(_moved(links, "a", parents, small), "b", parents, small)))
        turn += 1
    return labels
