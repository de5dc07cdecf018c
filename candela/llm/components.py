"""Connected components of a graph of links, by alternating large-star and small-star contraction.

Every round is a few grouped minima and equi-joins and is cut by a checkpoint; links are never gathered. A hub's links
are pre-aggregated by the grouped minimum and split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.common import durable


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """edges: a, b (orderable, not null, any direction). Returns node, label: the smallest node that node can reach.

    Nodes that are their own label are left out. Raises if max_rounds do not settle the labels.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    if state[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    for _ in range(max_rounds):
        # Large star: neighbours above u move to the smallest neighbour of u.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: u and its neighbours below move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = durable(small.where("a <> b").distinct())
        now = _state(edges)
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
