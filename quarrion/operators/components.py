"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.session import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; ``component`` is the component's least node.

    Labels move along edges and then jump to the label of their label, so the rounds needed grow as the logarithm
    of the longest path. Each round is cut by a checkpoint. Self edges and repeated ones do no harm; an edge with
    a null end is left out; no edges give no rows. Nothing but the count of changed labels comes to the driver.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    both = checkpointed(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label"))
    labels = checkpointed(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("seen"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        target = moved.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = checkpointed(moved.join(target, "label").select("node", "old", F.col("jump").alias("label")))
        if moved.where("label <> old").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        labels = moved.select("node", "label")
