"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.plans.store import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another one; root is the smallest node reachable.

    Every round takes the least of a node's label, its neighbours' labels and the label of its label, so that chains
    shrink fast, and ends in a written table. Links of a node with itself or with NULL say nothing.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        lower = labels.join(seen, "node").join(jump, "root")
        after = cut(lower.select("node", F.col("root").alias("old"), F.least("root", "m", "next").alias("root")))
        labels = after.select("node", "root")
        if after.filter("root <> old").isEmpty():
            return labels
