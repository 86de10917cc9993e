"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.rows import few, kept, lookup


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each end of a link, the smallest node reachable from it.

    Rounds of hooking and contraction: every node points to its smallest neighbour, pointers are followed to their ends
    by doubling, and the links between what is left form the next round. Each round at least halves the nodes of a
    component. A node with very many links costs one minimum, combined in each task first; the joins on such a node are
    inner joins that adaptive execution splits. Few links are kept in few parts, and pointers then looked up by a
    broadcast. Links with a null end are no links.
    """
    edges = kept(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    n = left = edges.count()
    edges = few(edges, n)
    roots = kept(few(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), 2 * n))
    while left:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = kept(few(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), 2 * left))
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            higher = kept(few(up.join(lookup(above, 2 * left), "up").select("node", "up", "top"), 2 * left))
            moved = not higher.filter("top <> up").isEmpty()
            up = higher.select("node", F.col("top").alias("up"))
            if not moved:
                break
        at = up.select(F.col("node").alias("root"), "up")
        roots = kept(few(roots.join(lookup(at, 2 * left), "root", "left").select("node", F.coalesce("up", "root").alias("root")), 2 * n))
        ends = edges.join(lookup(up.select(F.col("node").alias("a"), F.col("up").alias("x")), 2 * left), "a")
        ends = ends.join(lookup(up.select(F.col("node").alias("b"), F.col("up").alias("y")), 2 * left), "b")
        edges = kept(few(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), left))
        left = edges.count()
    return roots
