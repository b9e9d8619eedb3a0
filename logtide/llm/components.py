"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import counted, stored


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of a link; the component is its smallest node.

    ``links`` has the columns ``a`` and ``b``. A round takes the smallest label among the
    neighbours and then the label of that label, so that long chains shrink by halves; it
    ends when no label changes. Aggregates combine before their shuffle and joins have one
    row per key on one side, so a hub or a giant component is split by adaptive execution.
    Each round starts from a stored table.
    """
    links = stored(links.select("a", "b").where("a <> b")
                   .union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))
                          .where("a <> b")).distinct(), "links")
    labels = stored(links.groupBy(F.col("a").alias("node"))
                    .agg(F.least(F.min("b"), F.first("a")).alias("label"))
                    .withColumn("moved", F.lit(True)), "labels")
    nodes = labels.count()
    while not labels.where("moved").isEmpty():
        near = (links.join(counted(labels, nodes).select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        low = (counted(labels, nodes).join(near, "node")
               .select("node", F.col("label").alias("was"),
                       F.least("label", "near").alias("label")))
        low = stored(low, "labels")
        jump = counted(low, nodes).select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(low.join(jump, "label")
                        .select("node", F.col("next").alias("label"),
                                (F.col("next") != F.col("was")).alias("moved")), "labels")
    return counted(labels, nodes).select("node", F.col("label").alias("component"))
