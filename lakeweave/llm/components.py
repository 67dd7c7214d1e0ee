"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest reachable node) for every node of edges (a, b).

    Alternates large-star and small-star steps until nothing changes. A step takes each
    node's least neighbour by an aggregate and joins it back, so no neighbourhood is ever
    collected, and the joins may be split where a node has very many neighbours. Each
    round is written to the checkpoint folder. Null ends and loops are ignored; repeated
    edges count once; no edges give no rows.
    """
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(now)
    for _ in range(most_rounds):
        # large star: larger neighbours of u move to the least node around u
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(low, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = cut(moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        after = sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
