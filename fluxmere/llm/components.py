"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import SENT_ROWS, cut, gathered


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, component)``: the smallest node reachable, for every linked node.

    Links may repeat, point either way or join a node with itself; null ends are ignored;
    an empty table gives no rows. Each round takes the least label of a node's neighbours
    and then the label of that label, so rounds grow with the logarithm of the diameter.
    Labels of neighbours are aggregated within tasks before they are sent; a node or label that
    many rows share is one key of a join, which adaptive execution splits. Nothing is collected.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    ends = both.count()
    both = gathered(both, ends)
    label = cut(gathered(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), ends))
    send = F.broadcast if label.count() <= SENT_ROWS else lambda df: df
    while True:
        seen = both.join(send(label), both.b == label.node).select(both.a.alias("node"), "component", F.lit(None).cast("long").alias("old"))
        own = label.select("node", "component", F.col("component").alias("old"))
        near = seen.unionByName(own).groupBy("node").agg(F.max("old").alias("old"), F.min("component").alias("c"))
        up = label.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        nxt = cut(gathered(near.join(send(up), "c", "left").select("node", "old", F.least("c", "cc").alias("component")), ends))
        changed = nxt.where("old <> component").limit(1).count()
        label = nxt.select("node", "component")
        if not changed:
            return label
