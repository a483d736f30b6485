"""Connected components of an edge table, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.frames import materialised


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``vid, comp`` of every vertex of ``edges(a, b)``: comp is the smallest vertex reachable.

    Each round takes the smallest label among the neighbours and then the label of that label
    (pointer jumping), so chains shorten geometrically. ``start`` gives labels known already
    (vid, comp), each reachable from its vertex. Every round is a table in the shared folder;
    hubs are joins on a key that AQE can split, and minima are combined before the shuffle.
    """
    both = materialised(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "cc-edges",
    )
    labels = both.groupBy(F.col("a").alias("vid")).agg(F.min("b").alias("comp"))
    labels = labels.withColumn("comp", F.least("vid", "comp"))
    if start is not None:
        labels = labels.unionByName(start.select("vid", "comp")).groupBy("vid").agg(F.min("comp").alias("comp"))
    labels = materialised(labels, "cc-labels")
    while True:
        heard = both.join(labels.withColumnRenamed("vid", "a"), "a").select(F.col("b").alias("vid"), "comp")
        # the old label's own vertex hears of the new one too, which keeps old trees together
        kept = labels.select("vid", "comp")
        new = heard.unionByName(kept).groupBy("vid").agg(F.min("comp").alias("comp"))
        new = materialised(new, "cc-heard")
        root = new.select(F.col("vid").alias("comp"), F.col("comp").alias("top"))
        jumped = new.join(root, "comp", "left").select("vid", F.coalesce("top", "comp").alias("comp"))
        jumped = materialised(jumped, "cc-labels")
        moved = jumped.join(labels.withColumnRenamed("comp", "was"), "vid").where("comp != was")
        if moved.isEmpty():
            return jumped
        labels = jumped
