"""Connected components of a distributed edge list by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fits_broadcast, settle, spread_join

#: Times that a round replaces each parent by the parent's parent.
JUMPS = 3


def _follow(rows: DataFrame, name: str, parent: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` of a settled table with the parent of the node in the column ``name``; a node that very many rows name is not one task's work."""
    up = parent.select(F.col("v").alias(name), F.col("p").alias(f"{name}_up"))
    if fits_broadcast(parent.count()):
        return rows.join(F.broadcast(up), name, how)
    return spread_join(rows, up, [name], how)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node that can be reached.

    Each round every node takes its smallest neighbour, if smaller than itself, as parent;
    parents are followed a few steps and the edges are rewritten between the nodes reached.
    The rounds end when no edge between different nodes is left. By node only a minimum is
    gathered. The joins are of pairs of numbers: where the parents are few they are broadcast, and else the rows of a
    parent that very many nodes have are dealt over several tasks. Loops and repeated edges are allowed; rows with a null end are ignored. Tables of past rounds are deleted.
    """
    left = settle(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    roots = settle(nodes.select("node", F.col("node").alias("root")))
    while not left.filter("a <> b").isEmpty():
        open_ = left.filter("a <> b")
        both = open_.union(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = settle(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p")))
        for _ in range(JUMPS):
            jumped = settle(_follow(parent, "p", parent).select("v", F.col("p_up").alias("p")))
            discard(parent)
            parent = jumped
        new_roots = settle(_follow(roots, "root", parent, "left").select("node", F.coalesce("root_up", "root").alias("root")))
        half = settle(_follow(open_, "a", parent))
        rewritten = _follow(half, "b", parent).select(F.greatest("a_up", "b_up").alias("a"), F.least("a_up", "b_up").alias("b")).filter("a <> b").distinct()
        new_left = settle(rewritten)
        discard(parent, roots, left, half)
        roots, left = new_roots, new_left
    discard(left)
    return roots
