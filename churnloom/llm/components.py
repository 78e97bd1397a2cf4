"""Connected components of a link table, as Spark rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.llm.tables import materialize


def component_labels(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for links ``a``, ``b``.

    A round takes the smallest label among the neighbours and then that label's own label,
    so paths shorten by half or more; each round is written to the shared folder. Nodes
    without a link are not in the result.
    """
    edges = edges.select("a", "b")
    both = materialize(
        edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links"
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.first("a"), F.min("b")).alias("label")
        ),
        "labels",
    )
    while True:
        offers = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("offer"))
        )
        lower = labels.join(offers, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "offer").alias("lower")
        )
        hop = labels.select(F.col("node").alias("lower"), F.col("label").alias("next"))
        stepped = materialize(
            lower.join(hop, "lower").select(
                "node", F.least("lower", "next").alias("label"), "old"
            ),
            "labels",
        )
        changed = stepped.where("label <> old").limit(1).count()
        labels = stepped.select("node", "label")
        if not changed:
            return labels
