"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for ``links(a, b)``: the smallest node of each node's
    component.

    Each round gives a node the smallest label among its own and its
    neighbours' and then the label of that label, so the number of rounds is
    logarithmic in the longest path.  Every round is written to the shared
    folder; only the number of changes comes to the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.where("a <> b").distinct(), "cc-edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")),
                    "cc-labels")
    while True:
        far = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        offered = edges.join(far, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(offered, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = step.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("top", "label")).alias("label"))
        now = stored(jumped, "cc-labels")
        if now.where("label <> was").limit(1).count() == 0:
            return now.select("node", "label")
        labels = now.select("node", "label")
