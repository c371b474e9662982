"""Connected components by minimum labels with pointer jumping, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm import shared


def components(links: DataFrame) -> DataFrame:
    """v and comp (the smallest node of its component) for each node of ``links`` (a, b), undirected.

    A round takes the least label of a node's neighbours, then that label's own label, so the number
    of rounds grows with the logarithm of the longest path.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = shared.written(both, "edges")
    labels = shared.written(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["v"]).groupBy(F.col("a").alias("_a")).agg(F.min("comp").alias("_near"))
        met = labels.join(near, labels["v"] == near["_a"]).select("v", F.least("comp", "_near").alias("comp"), F.col("comp").alias("_was"))
        ahead = labels.select(F.col("v").alias("_v"), F.col("comp").alias("_ahead"))
        new = shared.written(met.join(ahead, F.col("comp") == F.col("_v")).select("v", F.least("comp", "_ahead").alias("comp"), "_was"), "labels")
        moved = not new.where("comp <> _was").isEmpty()
        shared.dropped(labels)
        labels = new.select("v", "comp")
        labels.written_to = new.written_to
        if not moved:
            shared.dropped(edges)
            return labels
