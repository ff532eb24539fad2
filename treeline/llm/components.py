"""Connected components of a link table, by labels and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.staging import drop, stage


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable over ``links`` (columns ``a, b``), for every node with a link.

    Each round takes the least label among neighbours (summed on the map side, so a node with very many links is no
    hot key), then follows labels once; rounds grow with the logarithm of the longest path. Every round is written to
    the shared folder, and the one before is removed. Loops and repeated links do no harm; an empty table gives an empty result.
    Both directions come from one read: a forest that is chosen anew when it is read again would have other links in the other one.
    """
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("link"))
    both = stage(both.select("link.a", "link.b").where("a <> b").distinct(), "links")
    written = labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("offer"))
        lower = labels.join(offered, labels["node"] == offered["a"]).select("node", F.col("component").alias("was"), F.least("component", "offer").alias("component"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        moved = lower.join(jump, lower["component"] == jump["via"], "left").select("node", "was", F.least("component", F.coalesce("beyond", "component")).alias("component"))
        moved = stage(moved, "labels")
        drop(written)
        written, labels = moved, moved.select("node", "component")
        if moved.where("was <> component").isEmpty():
            drop(both)
            return labels
