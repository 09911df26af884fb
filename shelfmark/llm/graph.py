"""Connected components of an undirected graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.tables import materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each end of ``edges`` (a, b), root being the least node reachable.

    Alternates two local steps until nothing changes: every node hands its smallest
    neighbour to its larger neighbours, then to its smaller ones. Edges never grow
    in number, stars stay stars whatever their size, and the number of rounds grows
    with the logarithm of the longest path. Each round is a written table, so that
    no plan grows and a lost executor costs a re-read. Nulls are no nodes.
    """
    now = materialise(edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(small, "a")
        after = materialise(
            kept.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        # a star: no node that is the end of one edge is the start of another
        if after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() and after.groupBy("a").count().where("count > 1").isEmpty():
            now = after
            break
        now = after
    else:
        raise RuntimeError(f"components were not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
