"""Connected components of a graph given as edges, by alternating stars.

Each round rewires the edges towards the smallest neighbour (first from the
larger neighbours, then from the smaller ones) until every vertex hangs on its
component's smallest vertex. Rounds are aggregates and joins; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.store import save


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours are tied to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every vertex of (u, v) edges; root is the component's smallest vertex."""
    def weight(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())

    now = save(edges.select("u", "v").where("u <> v").distinct(), "component-edges")
    before = None
    while True:
        state = weight(now)
        if state[0] == 0 or state == before:
            break
        before = state
        now = save(_small_star(_large_star(now)), "component-edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
