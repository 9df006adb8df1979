"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). One row for each node that has an edge: node, root (the smallest node of its component).

    An edge is kept as (larger, smaller) node. Small star: the smaller neighbours of a node are tied to the smallest of them. Large star:
    the smaller node of each edge gives way to its own smallest neighbour. Neither makes more edges than there were, so only
    the small star removes repeated ones; it is left out where no node has two smaller neighbours. Smallest neighbours are counted with partial sums and
    written before edges meet them, so that a node with very many edges (the root of a large component) is a skewed side of a plain
    join, which Spark deals out. Rounds grow with the logarithm of the longest path; each is written to the shared folder, so a
    lost executor costs one step. Loops (a = b) count as no edge. Nulls must not occur.
    """
    least = lambda e: written(e.groupBy("a").agg(F.min("b").alias("m"), (F.min("b") < F.max("b")).alias("more")), "least")
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    known = least(now)
    while True:
        if many := bool(known.filter("more").take(1)):
            tied = now.join(known.filter("more").select("a", "m"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            now = written(tied.union(known.select("a", F.col("m").alias("b"))).distinct(), "edges")
            known = least(now)
        below = known.select(F.col("a").alias("b"), "m")
        large = written(now.join(below, "b", "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved")), "edges")
        if large.filter("moved").take(1):
            now = large.select("a", "b")
            known = least(now)
        elif not many or not known.filter("more").take(1):
            break
    return known.select(F.col("a").alias("node"), F.col("m").alias("root")).union(known.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
