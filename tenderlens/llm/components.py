"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenderlens.sources.staging import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                 .first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); the root is the component's least node.

    Alternating large and small stars: each round ties the neighbours of a node to the least of
    them. Minima are combined before the shuffle and written, so the join with them is over plain
    files and a node with a large part of the links is split (or the minima are broadcast, if
    their size allows). Every round is written to the shared folder, which cuts the lineage.
    """
    edges = stage(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b")
                  .distinct(), "links")
    known = _state(edges)
    while known[0]:
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        least = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = stage(both.filter("b > a").join(least, "a").selectExpr("b a", "m b")
                      .filter("a <> b"), "large")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        edges = stage(large.join(least, "a").selectExpr("explode(array(a, b)) a", "m b")
                      .filter("a <> b").distinct(), "small")
        state = _state(edges)
        if state == known:
            break
        known = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.selectExpr("a node", "b root").unionByName(roots)
