"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _large(edges: DataFrame, scratch: C.Scratch) -> DataFrame:
    """Each node ties its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the smallest of them. Edges have a > b.

    After a large star a node has few smaller neighbours, so no key is frequent here.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    tied = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.unionByName(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame, scratch: C.Scratch | None = None) -> DataFrame:
    """(node, root) of all nodes of edges (a, b) of type long but the roots: root is the smallest node that node reaches.

    The result lies in a table of scratch. Each round is a few joins and sums over at most twice as many rows as there are edges, and the number of rounds
    grows with the logarithm of the longest path. Loops and repeated edges do no harm.
    """
    clean = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    scratch, own = scratch or C.Scratch(edges.sparkSession), C.Scratch(edges.sparkSession)
    now = own.keep(clean(edges), "edges")
    while not now.isEmpty():
        now = own.keep(clean(_small(own.keep(clean(_large(now, own)), "edges"))), "edges")
        own.drop_but(now)
        if now.join(now.select(F.col("a").alias("other")), F.col("b") == F.col("other"), "left_semi").isEmpty():
            break  # every edge ends in a root
    scratch.tables += own.tables
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
