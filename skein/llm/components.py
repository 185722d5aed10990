"""Connected components by minimum labels and pointer jumping, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b): component is the smallest node that can be reached.

    No edges give no rows.  A step takes the least label among a node and its neighbours and then the label of that
    label, so chains shrink geometrically; each step is a table in the shared folder.
    """
    both = stage(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")).distinct(), "arcs")
    comp = stage(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    while True:
        near = both.join(comp, both.dst == comp.node).groupBy("src").agg(F.min("component").alias("near"))
        least = stage(comp.join(near, comp.node == near.src, "left").select("node", "component", F.least("component", "near").alias("next")), "least")
        target = least.select(F.col("node").alias("_at"), F.col("next").alias("_to"))
        moved = least.join(target, least.next == target._at, "left").select("node", F.least("next", F.coalesce("_to", "next")).alias("next"), "component")
        moved = stage(moved, "labels")
        if moved.filter("next <> component").isEmpty():
            return moved.select("node", "component")
        comp = moved.select("node", F.col("next").alias("component"))
