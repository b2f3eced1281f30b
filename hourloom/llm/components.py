"""Connected components of links, by alternating stars: no group is collected anywhere and each round halves the depth of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import materialise

ROUNDS = 60


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node and component (the smallest node that links reach) for the nodes of links(a long, b long) that differ from their component.

    Large star: each node's larger neighbours move to its smallest neighbour. Small star: each node and its smaller
    neighbours move to the smallest of them. Both keep the components, and every round is written to the shared folder, so lost
    executors cost no earlier round. A node with very many links is pre-aggregated by min() and its join can be split. rows: a bound of the links."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links", rows)
    twice = None if rows is None else 2 * rows
    for _ in range(ROUNDS):
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")
        # Written before the join, so that it reads both sides from exchanges that AQE can split.
        nodes = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above")), "nodes", twice)
        if not nodes.filter("below > 1 OR (below > 0 AND above > 0)").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))  # every tree is a star around its smallest node
        large = both.filter("v > u").join(nodes.select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = materialise(large, "large-star", twice)
        lowest = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "lowest", twice)
        moved = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        small = large.join(lowest, "u").select(F.explode(moved).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = materialise(small, "small-star", twice)
    raise RuntimeError(f"links did not come together in {ROUNDS} rounds")
