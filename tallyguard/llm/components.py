"""Connected components of an edge table by smallest-neighbour hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.frames import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the component's smallest node.

    Each round, every node takes the smallest label among its own and its neighbours', and then its
    label's label; rounds end when nothing changes, after about log(diameter) of them. All state is
    a table in the shared folder; joins and minima are split and combined by Spark, so a hub's
    neighbours never meet in one task unaggregated.
    """
    links = stored(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links"
    )
    labels = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root"))
    labels = stored(labels, "labels")
    while True:
        offers = links.join(labels, links.b == labels.node).groupBy("a").agg(F.min("root").alias("offer"))
        hooked = labels.join(offers, labels.node == offers.a).select("node", F.col("root").alias("old"), F.least("root", "offer").alias("root"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("up"))
        fresh = stored(
            hooked.join(jump, hooked.root == jump["at"], "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "labels"
        )
        labels = fresh.select("node", "root")
        if fresh.filter("old <> root").isEmpty():
            return labels
