"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over edges, so no node list meets in one place; rounds
grow with the logarithm of the longest chain. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v). Links each node's larger (or smaller) neighbours to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u")
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); root is the least node reachable.

    Repeated edges and loops are allowed; a node with loops only does not appear.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        old, edges = edges, materialise(_star(_star(edges, True), False), "edges")
        discard(old)
        # decimal sums: long sums of hashes could overflow
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    # each round of the two stars at least halves what is left of a chain, so this many rounds are more
    # than any number of rows can need
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
