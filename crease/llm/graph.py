"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crease.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (two integer columns a, b); a component is its smallest node.

    Each round sends every node to its smallest neighbour, if that is smaller,
    and renames the edges; at least half of the nodes that are left go in two
    rounds.  Rounds are written, so a lost executor costs one round at most.
    Nodes with very many neighbours are aggregated before the shuffle.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    maps = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        parent = stored(parent.select("node", F.least("node", "least").alias("parent")), "cc-parents")
        maps.append(parent)
        left = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        renamed = edges.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        edges = stored(renamed.where("a <> b").distinct(), "cc-edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps[0].select("node", F.col("parent").alias("at"))
    for parent in maps[1:]:
        step = parent.select(F.col("node").alias("at"), "parent")
        found = found.join(step, "at", "left").select("node", F.coalesce("parent", "at").alias("at"))
    return stored(found.select("node", F.col("at").alias("component")), "cc-found")
