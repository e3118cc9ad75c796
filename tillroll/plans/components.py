"""Connected components by contraction.

Every node hooks onto the smallest node it shares an edge with; the forest this
makes is flattened by pointer jumping (a path of n nodes takes log2 n jumps), each tree becomes
one node, and edges between trees go into the next round.  A round at least halves
the trees that still have edges, so rounds and jumps grow with the logarithm of the nodes, not
with the length of the longest path.  Edges and parents are cut from their
lineage in the shared checkpoint folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.session import checkpointed


def _flatten(parents: DataFrame) -> DataFrame:
    """(node, parent) forest -> (node, root) by pointer jumping."""
    while True:
        up = parents.select(F.col("node").alias("_p"), F.col("parent").alias("_pp"))
        jumped = parents.join(up, parents.parent == up._p, "left").select(
            "node", F.coalesce("_pp", "parent").alias("parent"), (F.coalesce("_pp", "parent") != F.col("parent")).alias("_moved"))
        jumped = checkpointed(jumped)
        if jumped.filter("_moved").isEmpty():
            return jumped.select("node", "parent")
        parents = jumped.select("node", "parent")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node in ``edges``; the component is its smallest node.  Null ends are ignored."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
    nodes = checkpointed(both.select(F.col("x").alias("node")).distinct())
    label = nodes.select("node", F.col("node").alias("component"))
    live = checkpointed(both.filter("x <> y").distinct())
    while not live.isEmpty():
        hook = live.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("parent"))
        root = _flatten(checkpointed(hook))
        label = checkpointed(label.join(root, label.component == root.node, "left").select(
            label.node, F.coalesce(root.parent, label.component).alias("component")))
        l, r = root.select(F.col("node").alias("x"), F.col("parent").alias("_x")), root.select(F.col("node").alias("y"), F.col("parent").alias("_y"))
        live = checkpointed(live.join(l, "x").join(r, "y").filter("_x <> _y").select(F.col("_x").alias("x"), F.col("_y").alias("y")).distinct())
    return label
