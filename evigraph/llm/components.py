"""Connected components of a graph given as edges, by alternating large-star and small-star steps on DataFrames.

Each step shuffles edges only; nothing is collected but the names of hubs, which are few. Lineage is cut by tables in the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hubs, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours (larger ones, or those not larger) of each vertex to the smallest of its neighbourhood.

    The smallest neighbour comes from an aggregate with partial sums; hubs get it by a broadcast of their own, so a
    vertex with very many neighbours is never gathered in one task.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    if large:
        both = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-both")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = written(join_hubs(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-edges")
        discard(both)
        return out
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = join_hubs(edges, least, "u")
    links = joined.where("u != v").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = written(links.where("u != v").distinct(), "cc-edges")
    discard(edges)
    return out


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """vertex, component (its smallest vertex) for every vertex that has an edge; edges: u, v."""
    now = written(edges.select("u", "v").where("u != v").distinct(), "cc-edges")
    before = None
    for _ in range(most_rounds):
        edges, now = now, _star(_star(now, True), False)
        discard(edges)
        # the smaller ends only fall: equal sums mean that nothing has changed
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        state = (r["n"], r["s"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    stars = now.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
