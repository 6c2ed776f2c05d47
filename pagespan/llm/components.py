"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespan.llm.shared import dropped, written

#: Edges that one task may hold.
FEW = 200_000


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """node and component (smallest node reachable) of all nodes but components' smallest.

    Each round hangs nodes under smaller ones; it ends when every node hangs under its component's
    smallest, after about log2 of the longest path's rounds. Each round is a written table, sums
    are pre-aggregated, and a node of very many edges is one skewed key of a plain join.
    Null ends are no edge; an empty table gives an empty one.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    now = written(now, "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark
        table = now
        if mark["n"] <= FEW:  # counted: so few edges are one partition's work, without exchanges
            now = now.coalesce(1)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "edges")
        table_large, large = large, large.coalesce(1) if mark["n"] <= FEW else large
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(table)
        dropped(table_large)
        now = small
