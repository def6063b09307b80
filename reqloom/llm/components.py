"""Connected components of an edge list by alternating star contraction.

Each round rewrites every edge towards the smallest neighbour known so far
(large star, then small star), so the edge list never outgrows its first size
and a hub's neighbours are never gathered: a hub contributes one aggregated
minimum, joined back to its edges by a sort-merge join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqloom.llm.common import delete_path, written_at


def _large_star(edges: DataFrame) -> DataFrame:
    """(u, v) both ways: every larger neighbour of u points to the least of u's closed neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges go from larger (a) to smaller (b): a and its smaller neighbours point to the least of them."""
    least = edges.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
    joined = edges.join(least, edges["a"] == least["k"])
    lower = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("k").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(own).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the least node of its component.

    Roots themselves are included. Null ends and self-loops are ignored; no
    edges give an empty table. Raises RuntimeError if ``max_rounds`` don't do.
    """
    oriented = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    current, path = written_at(oriented, "edges")
    seen = None
    for _ in range(max_rounds):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        seen = state
        after, next_path = written_at(_small_star(_large_star(current)), "edges")
        delete_path(edges.sparkSession, path)
        current, path = after, next_path
    raise RuntimeError("components did not converge")
