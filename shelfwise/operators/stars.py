"""Greedy stars in parallel rounds.

Nodes are taken by number. One that no earlier star has taken becomes the middle of a star of all its later neighbours that
are still free. So the middles are the first maximal set of nodes without a link among them: a node is a middle if none of
its earlier neighbours is, and a node that isn't goes to the smallest middle beside it. Each round decides every node whose earlier
neighbours are decided, or one of whose neighbours has become a middle; rounds grow with the longest chain of nodes that wait
for each other, not with their number.

Nodes aren't linked one by one: they hang on hubs (keys that they have), and hubs are near each other. Nodes with the same
mates are not neighbours. Of each hub only its smallest node and the smallest with other mates can matter to anyone, so a
round moves two rows a hub, and no group of nodes is ever in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import settled

OPEN, NEW, MIDDLE, TAKEN = 0, 1, 2, 3


def _smallest(nodes: DataFrame, *keys: str) -> DataFrame:
    """hub, keys, first, mates: the two smallest nodes of different mates of each hub."""
    lows = nodes.groupBy("hub", *keys, "mates").agg(F.min("node").alias("first"))
    order = Window.partitionBy("hub", *keys).orderBy("first")
    return lows.withColumn("_n", F.row_number().over(order)).filter("_n <= 2").select("hub", *keys, "first", F.col("mates").alias("_mates"))


def _sees(reads: DataFrame, smallest: DataFrame) -> DataFrame:
    """Of the hubs that nodes look at, the nodes before them and not of their mates."""
    return reads.join(smallest, "hub").filter((F.col("first") < F.col("node")) & (F.col("mates").isNull() | ~F.col("mates").eqNullSafe(F.col("_mates"))))


def stars(nodes: DataFrame, hangs: DataFrame, near: DataFrame) -> DataFrame:
    """nodes: node, mates (null: none); hangs: node, hub; near: hub, other, both ways. Hubs are near themselves. Gives node,
    middle of all nodes that were taken."""
    both = near.unionByName(hangs.select("hub", F.col("hub").alias("other"))).distinct()
    on = settled(hangs.join(nodes, "node"))
    looks = settled(on.join(both, "hub").select("node", "mates", F.col("other").alias("hub")).distinct())
    state = settled(nodes.select("node", F.lit(OPEN).alias("state")))
    while True:
        active = on.join(state.filter(F.col("state") <= NEW), "node")
        waiting = looks.join(state.filter(F.col("state") == OPEN).select("node"), "node")
        seen = _sees(waiting, _smallest(active, "state")).groupBy("node").agg(F.max("state").alias("most"))
        # A new middle beside a node takes it; nothing open before it makes it a middle; else it waits.
        decided = F.when(F.col("most") == NEW, TAKEN).when(F.col("most").isNull(), NEW).otherwise(OPEN)
        moved = state.join(seen, "node", "left").select("node", F.when(F.col("state") == OPEN, decided).when(F.col("state") == NEW, MIDDLE).otherwise(F.col("state")).alias("state"))
        state = settled(moved)
        if state.filter(F.col("state") == OPEN).isEmpty():
            break
    middles = on.join(state.filter(F.col("state").isin(NEW, MIDDLE)).select("node"), "node")
    taken = looks.join(state.filter(F.col("state") == TAKEN).select("node"), "node")
    return _sees(taken, _smallest(middles)).groupBy("node").agg(F.min("first").alias("middle"))
