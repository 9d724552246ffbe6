"""Connected components of a graph given as edges, without gathering any component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v): root is the lowest node of the component.

    Each round hangs every node on its lowest neighbour, shortens that by one more step and contracts the graph, so the
    number of rounds grows with the logarithm of the longest path. Each round's tables are written to the checkpoint folder.
    """
    both = edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    live = stored(both.distinct(), "edges")
    roots = None
    while not live.isEmpty():
        low = live.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        low = stored(low.join(low.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")), "parents")
        if roots is None:
            roots = low.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            roots = stored(roots.join(low.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        left = live.join(low, "u").select(F.col("p").alias("a"), "v")
        live = stored(left.join(low.select(F.col("u").alias("v"), F.col("p").alias("b")), "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
    return roots if roots is not None else live.select(F.col("u").alias("node"), F.col("v").alias("root"))
