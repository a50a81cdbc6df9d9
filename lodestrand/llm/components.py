"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Share of the rows, and number of rows, from which a node counts as frequent.
FREQUENT, LEAST_FREQUENT = 1e-4, 256


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _beside_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """Add the least neighbour m of u to each row (u, v). least: u, m and n, the number of its rows.

    A node with many rows would bring them all into one task. Of nodes with more than a FREQUENT share of all rows
    there are 1 / FREQUENT at most, so these are broadcast and their rows stay where they are.
    """
    often = F.col("n") > max(LEAST_FREQUENT, FREQUENT * 2 * edges)
    marked = rows.join(F.broadcast(least.filter(often).select("u", F.col("m").alias("_m"))), "u", "left")
    rest = marked.filter("_m IS NULL").select("u", "v").join(least.filter(~often).select("u", "m"), "u")
    return marked.filter("_m IS NOT NULL").select("u", "v", F.col("_m").alias("m")).unionByName(rest)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of an edge list (u, v) reaches.

    Self-loops and repeated edges do no harm; nodes without an edge are not in the result. The edges
    stay distributed: each round writes them to the shared folder, so it survives lost executors.
    """
    edges = materialise(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = _mark(edges)
    if not seen[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _beside_least(both, least, seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = _beside_least(large, least, seen[0])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialise(small.filter("u <> v").distinct(), "small-star")
        now = _mark(edges)
        discard(before, large)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
