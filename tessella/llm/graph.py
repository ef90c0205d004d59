"""Connected components of a graph of links, without collecting any of it."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import forget, park


def _smallest(edges: DataFrame) -> DataFrame:
    """u and m: the smallest of u and its neighbours. Counted map-side, so a node of very many links is no hot task."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node and component, its smallest reachable node, for every node of the edges (a, b).

    Alternates two star operations until nothing changes: links of a node to its larger neighbours move to the smallest one
    around it, then those to its smaller neighbours do. More than `rounds` rounds, where it is given, are an error. Every step
    is a grouped minimum, which is counted map-side, and a join on the node. Minima are written as tables, so that adaptive
    execution can split the join where a node is hot, and a lost executor repeats one step.
    """
    now = park(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for done in itertools.count():
        if done == rounds:
            raise RuntimeError(f"components have not settled in {rounds} rounds")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = park(_smallest(both), "smallest")
        large = park(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "links")
        least_large = park(_smallest(large), "smallest")
        joined = large.join(least_large, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, now = now, park(small, "links")
        forget(old, least, large, least_large)
        facts = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if facts == before or not facts[0]:
            break
        before = facts
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
