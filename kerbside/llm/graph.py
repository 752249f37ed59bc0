"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) undirected edges to (node, component): the smallest node that can be reached.

    Edges point from the larger node ``u`` to the smaller ``v``. Each round first moves an
    edge's lower end to that end's smallest neighbour (large star), then points all lower ends
    of a node, and the node, at the smallest of them (small star). Per-node minima combine in
    the tasks before the shuffle and are written, so that both sides of the joins are plain
    exchanges: a hub's rows are then split over tasks where Spark finds the key skewed. It
    ends when each node has one edge and no edge leads to a node that has one itself.
    Loops, repeated edges and either order of the ends are allowed; nodes without an edge to
    another are not returned; empty edges give an empty table.
    """
    pairs = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    for _ in range(rounds):
        low = smallest(pairs)
        onward = pairs.join(low, F.col("v") == F.col("key"), "left")
        if low.count() == pairs.count() and onward.filter("key is not null").isEmpty():
            break
        large = checkpoint(onward.select("u", F.coalesce("m", "v").alias("v")).distinct())
        met = large.join(smallest(large), F.col("u") == F.col("key"))
        pairs = checkpoint(met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def smallest(pairs: DataFrame) -> DataFrame:
    """(key, m): the smallest lower end of each upper one."""
    return checkpoint(pairs.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("m")))
