"""Connected components of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _jump(p: DataFrame) -> DataFrame:
    """(node, p) with every p a root: pointers double until none moves."""
    while True:
        to = p.select(F.col("node").alias("via"), F.col("p").alias("next"))
        q = cut(p.join(to, F.col("p") == F.col("via")).select("node", F.col("next").alias("p"), (F.col("next") != F.col("p")).alias("moved")))
        p = q.select("node", "p")
        if q.filter("moved").isEmpty():
            return p


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, comp): for each node of a link the smallest node that it reaches.

    Each round points every node at its smallest neighbour, contracts the trees that this makes and keeps the
    links between different trees. Joins are between written tables on a node, so that hot nodes can be split.
    """
    e, labels = cut(links.select("a", "b").filter("a <> b").distinct()), None
    while labels is None or not e.isEmpty():
        both = e.union(e.select(F.col("b"), F.col("a")))
        p = _jump(cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("p"))))
        if labels is None:
            labels = p.select("node", F.col("p").alias("comp"))
        else:
            to = p.select(F.col("node").alias("comp"), F.col("p"))
            labels = cut(labels.join(to, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")))
        left = e.join(p.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").select("pa", "b")
        e = cut(left.join(p.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    return labels
