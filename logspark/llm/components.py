"""Connected components of a link table, by rounds of label passing with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the links (a, b) reaches.

    Large-star and small-star steps by turns: each node hands its neighbours to the
    least of them, which at least halves the depth of every tree. The links are
    written anew each round, so that no lineage grows and lost tasks find their
    input. A node's neighbours are never gathered: only least ones are.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        "links",
    )
    before = None
    while True:
        # Large star: neighbours above a node move to the least of all its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = (
            both.where("b > a")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
        )
        # Small star: a node and its lesser neighbours move to the least of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(lowest, "a")
            .select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = written(small, "links")
        # Settled once a round changes nothing.
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).first()
        now = (state["n"], state["sum"])
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
