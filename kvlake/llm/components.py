"""Connected components of a link table, by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b, any order, repeated or not.  Returns node and component (its smallest node).

    Each round takes the least label of the neighbours, then the label of the label, and is written to the shared
    folder.  Rounds follow the logarithm of a chain's length; a hub only makes a hot join key, which adaptive execution
    splits.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = materialize(both, "cc-edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("label")), "cc-labels")
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_m"))
        least = labels.join(around, labels["node"] == around["a"]).select("node", F.col("label").alias("_old"), F.least("label", "_m").alias("_least"))
        roots = labels.select(F.col("node").alias("_root"), F.col("label").alias("_further"))
        after = materialize(least.join(roots, F.col("_least") == F.col("_root")).select("node", F.least("_least", "_further").alias("label"), (F.least("_least", "_further") != F.col("_old")).alias("changed")), "cc-labels")
        labels = after.select("node", "label")
        if after.where("changed").isEmpty():
            return labels.withColumnRenamed("label", "component")
