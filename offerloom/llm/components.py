"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import Stored


def _downward(edges: DataFrame) -> DataFrame:
    """Every link once, from the larger to the smaller node."""
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _downward(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _downward(moved.union(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; the root is the smallest node.

    Alternating large and small stars: each round sends every node's neighbours
    to its smallest one, so that the longest path shrinks geometrically; the
    rounds end when the links stay the same.  A node's links are never
    gathered: its smallest neighbour is a partial aggregate, joined back in a
    join that is split where a node is frequent.  Each round is a written table.
    """
    now, mark = Stored(_downward(edges), "links"), None
    while True:
        count, bits = now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if not count or (count, bits) == mark:
            break
        mark = (count, bits)
        after = Stored(_small_star(_large_star(now.df)), "links")
        now.empty()
        now = after
    roots = now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
