"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from watchkeep.llm.common import store


def _settle(parents: DataFrame) -> DataFrame:
    """(v, p) with every p replaced by the root its chain of parents leads to."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = store(parents.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "jump")
        parents = jumped.select("v", "p")
        if not jumped.where("moved").head(1):
            return parents


def components(links: DataFrame) -> DataFrame:
    """(v, root): the smallest id reachable from each id in ``links`` (a, b).

    Every round links each vertex to its smallest neighbour, follows these
    links to their end, and keeps the links between different ends.  Minima
    combine before the shuffle, so a vertex with very many links is no hot key;
    joins on it are split by adaptive execution.
    """
    left = store(links.select("a", "b").where("a <> b").distinct(), "links")
    roots = None
    while True:
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = store(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n")).select(
            "v", F.least("v", "n").alias("p")), "nearest")
        parents = _settle(nearest)
        if roots is None:
            roots = parents.select("v", F.col("p").alias("root"))
        else:
            up = parents.select(F.col("v").alias("root"), "p")
            roots = store(roots.join(up, "root", "left").select("v", F.coalesce("p", "root").alias("root")), "roots")
        at = lambda side: parents.select(F.col("v").alias(side), F.col("p").alias(f"p{side}"))
        left = store(left.join(at("a"), "a").join(at("b"), "b").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "links")
        if not left.head(1):
            return roots
