"""Connected components of an undirected graph given as edges, by alternating large and small stars.

Edges point down, from the larger node to the smaller one. Every step is a grouped minimum and a join and is written to the shared
folder, so no list of neighbours is ever built, plans stay short, nothing but one number per round reaches the driver, and a lost
executor costs its own tasks. A node with very many neighbours is a hot key of a join, which adaptive execution splits. Rounds end
as soon as the edges are stars, whose centre is the smallest node; edges that are stars already take none.

Defined cases: repeated edges count once, loops (a, a) and edges with a NULL end are left out, so a node that has no other edge is
not in the result; without edges the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.context import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """The lower end of each edge moves to its own least neighbour, if it has a lower one."""
    least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    return edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours move to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a != b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two lower neighbours, or lower and higher ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.filter("down > 1 OR down = 1 AND up = 1").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``node, component`` (the smallest node) of every node of ``edges(a, b)``; nodes are whole numbers."""
    down = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))  # a NULL end compares as unknown
    now = materialize(down.distinct(), purpose)
    while not _are_stars(now):
        now = materialize(_large_star(now), purpose)  # written, as the small stars read it twice
        now = materialize(_small_star(now), purpose)
    roots = now.select(F.col("b").alias("node")).distinct()  # each a now has exactly one b, its smallest node
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
