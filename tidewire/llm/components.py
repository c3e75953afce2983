"""Connected components of a graph given as an edge table, by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import Workspace, attach


def components(edges: DataFrame, work: Workspace, most_rounds: int = 60) -> DataFrame:
    """From undirected edges (u, v) of longs: one row (doc_id, label) a vertex with an edge; label is the smallest id it
    reaches. Null ends are no edge; repeated edges and loops change nothing; no edges give an empty result.

    Each half round is a map-side combined minimum, and its return to the edges of the vertex. A hub, a vertex with at least
    1 in HOT_PARTS of all edges, gets its minimum by broadcast, so its edges stay in the tasks they are in. What a half round
    gives is written to the shared folder, so plans stay short and a lost executor costs its own tasks.
    """
    now = work.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    n, state = now.count(), None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u is tied to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("c"))
        large = attach(both.filter("v > u"), low, ["u"], F.col("c"), 2 * n, "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.keep(large, "large")
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        small = attach(large, low, ["u"], F.col("c"), large.count(), "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        seen = Observation()
        new = work.keep(small.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v").cast("long")).alias("s")), "edges")
        was, state = state, seen.get
        n = state["n"]
        work.drop(now, large)
        now = new
        if was == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("doc_id"), F.col("v").alias("label")).distinct())
