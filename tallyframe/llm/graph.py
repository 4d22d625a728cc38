"""Connected components by minimum labels and pointer jumping, as joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; component is the smallest node that links reach.

    Each round takes the smallest label among the neighbours and then the label of that label, so that long chains
    shorten by halves. A round is stored in the shared folder; only a count of changes comes to the driver. Self links
    and repeated links do no harm; no links give no rows.
    """
    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    both = stored(ends.union(ends.select("v", "u")).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels, both.u == labels.node).groupBy("v").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.v).select("node", F.least("label", "near").alias("next"), "label")
        of = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = hooked.join(of, F.col("next") == F.col("_n"), "left").select(
            "node", F.least("next", F.coalesce("_l", "next")).alias("label"), (F.least("next", F.coalesce("_l", "next")) != F.col("label")).alias("changed")
        )
        labels_next = stored(jumped, "labels")
        if not labels_next.where("changed").head(1):
            return labels_next.select("node", F.col("label").alias("component"))
        labels = labels_next.select("node", "label")
