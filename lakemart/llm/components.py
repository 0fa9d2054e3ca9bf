"""Connected components of a distributed list of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Times that pointers are doubled in a round.
JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every end of an edge ``(a, b)`` of longs; ``root`` is the smallest id
    of the component.

    Rounds of contraction: each vertex points to its smallest neighbour (or itself), pointers
    are doubled a few times, the edges move to where their ends point, and edges inside one
    vertex drop out.  Chains shrink by a power of two in a round, so the rounds grow with the
    logarithm of the longest chain.  Every round is a written table; nothing reaches the
    driver but a count."""
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    root = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).select("id", F.least("id", "to").alias("to"))
        point = staged(point, "point")
        for k in range(JUMPS):
            ahead = point.select(F.col("id").alias("to"), F.col("to").alias("further"))
            point = point.join(ahead, "to").select("id", F.col("further").alias("to"))
        point = staged(point, "point")
        root = point.select("id", F.col("to").alias("root")) if root is None else staged(_follow(root, point), "root")
        one = edges.join(point.select(F.col("id").alias("a"), F.col("to").alias("p")), "a").select("p", "b")
        two = one.join(point.select(F.col("id").alias("b"), F.col("to").alias("q")), "b").where("p <> q")
        edges = staged(two.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
    if root is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return root


def _follow(root: DataFrame, point: DataFrame) -> DataFrame:
    """Move roots on to where they point now; roots without an edge left stay."""
    on = point.select(F.col("id").alias("root"), F.col("to").alias("further"))
    return root.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"))
