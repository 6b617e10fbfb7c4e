"""Connected components of a link table by repeated contraction.

Each round every node points to the smallest of itself and its neighbours in a freshly hashed order, and the links are rewritten to the nodes
pointed to. A third or more of the nodes go in an average round, whatever the shape, so the rounds grow with the logarithm of the largest
component. Minima combine before the shuffle, so a node with very many links is no hot group. Each round is a written table in the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.llm.tables import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node in ``links(a bigint, b bigint)``; nodes of one component have one root, itself a node."""
    both = links.filter("a <> b").select("a", "b")
    edges = scratch.keep(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(pointers)), F.col(c)), F.col(c))
        lowest = edges.groupBy("a").agg(F.min(order("b")).alias("m"))
        target = F.when(F.col("m") < order("a"), F.col("m")["b"]).otherwise(F.col("a"))
        moved = scratch.keep(lowest.select(F.col("a").alias("node"), target.alias("to")))
        half = edges.join(moved.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").select("b", "ta")
        whole = half.join(moved.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b").filter("ta <> tb")
        edges = scratch.keep(whole.select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())
        pointers.append(moved)
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = pointers[0].select("node", F.col("to").alias("root"))
    for moved in pointers[1:]:  # later tables shrink geometrically
        step = moved.select(F.col("node").alias("root"), "to")
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return scratch.keep(out)
