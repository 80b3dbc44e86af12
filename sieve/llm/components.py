"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import join_skewed, staged, unstaged


def _star(edges: DataFrame, small: bool, total: int) -> DataFrame:
    """Each vertex u ties its larger (small star: smaller) neighbours and itself to the least of them all.

    A vertex never gathers its neighbours: only their minimum is computed, and joined back, to hubs by a broadcast of
    the few vertices that have a large part of all edges (``total`` bounds their number).
    """
    if small:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    tied = join_skewed(sides, least, "u", "n", 2 * total)
    if small:
        out = tied.select(F.col("v").alias("a"), "m").union(least.select(F.col("u").alias("a"), "m"))
    else:
        out = tied.where("v > u").select(F.col("v").alias("a"), "m")
    return out.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(vertex, root) of every vertex that has an edge; root is the least vertex of its component.

    Null ends and self-loops are ignored.  Each round is written to the shared folder and the one before it deleted, so
    lost executors redo one round at most; the rounds grow with the logarithm of the longest path.
    """
    now = staged(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct())
    mark, total = None, now.count()
    while True:
        # the large star is written too, as its result is read for the minima and for the joins with them
        large = staged(_star(now, False, total))
        before, now = now, staged(_star(large, True, total))
        unstaged(before, large)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if tuple(found) == mark:
            break
        mark, total = tuple(found), found[0]
    roots = now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.union(roots.select("root").distinct().select(F.col("root").alias("vertex"), "root"))
