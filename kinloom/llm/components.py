"""Connected components of a table of links, without a driver-side graph.

Each node keeps a parent. In a round every node learns the smallest grandparent
among its neighbours; it, its parent and its grandparent may take that smaller
parent, and every node moves up to its grandparent. Rounds go on until no parent
changes; their number grows with the logarithm of the longest chain.

A round is joins and minima with partial aggregates, so that neither a node with
very many links nor a very large component lands in one task, and is written to
the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is its smallest node.

    Null ends, links of a node with itself and repeated links change nothing.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = cut(one.union(one.select("v", "u")).distinct())
    tree = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up")))
    while True:
        grand = tree.select(F.col("node").alias("up"), F.col("up").alias("top"))
        now = cut(tree.join(grand, "up").select("node", "up", "top"))
        near = both.join(now.select(F.col("node").alias("v"), "top"), "v").groupBy("u").agg(F.min("top").alias("low"))
        seen = now.join(near, now["node"] == near["u"]).select("node", "up", "top", "low")
        offers = seen.select(F.explode(F.array(F.struct("node", F.least("low", "top", "up").alias("to")), F.struct(F.col("up").alias("node"), F.least("low", "top").alias("to")))).alias("o")).select("o.*")
        new = cut(offers.groupBy("node").agg(F.min("to").alias("to")).join(tree, "node").select("node", F.least("to", "up").alias("up"), (F.least("to", "up") < F.col("up")).alias("moved")))
        tree = new.select("node", "up")
        if new.filter("moved").isEmpty():
            return tree.select("node", F.col("up").alias("component"))
