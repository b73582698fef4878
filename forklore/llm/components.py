"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forklore.session import materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v; any integers); root is the least node reachable.

    Alternates two steps until nothing changes: every neighbour above a node is tied to
    the least neighbour, then every neighbour below. Rounds grow with the logarithm of
    the longest path. Each round is a table in the shared folder, so a lost executor costs one
    round at most. Minima are taken before the join, and a node with very many neighbours
    is an ordinary skewed join, which Spark splits. No links give an empty result.
    """
    u, v = F.col("u"), F.col("v")
    links = links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    now = materialize(links.distinct(), "links")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v"))
        up = up.where(u != v).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u")
        down = down.select("u", F.col("m").alias("v")).unionByName(
            down.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        )
        now = materialize(down.distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(u.alias("node"), v.alias("root"))
    return nodes.unionByName(now.select(v.alias("node"), v.alias("root")).distinct())
