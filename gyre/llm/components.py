"""Connected components of a graph given as pairs of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.llm.session import written


def components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (_x, _y) with the least node that each one reaches: _node, _comp.

    Every round points each node to its least neighbour, follows the pointers to their roots, and puts the
    roots in place of the nodes. Edges inside a tree are gone with that and parallel ones become one, so that a
    round joins only the edges left, between at most half as many nodes. Each step is written to the shared folder.
    """
    left, names = _between(edges), None
    while names is None or not left.isEmpty():
        roots = _roots(left)
        x, y = (roots.select(F.col("_node").alias(c), F.col("_up").alias(f"_u{c}")) for c in ("_x", "_y"))
        left = _between(left.join(x, "_x").join(y, "_y").select(F.col("_u_x").alias("_x"), F.col("_u_y").alias("_y")))
        if names is None:
            names = roots.select("_node", F.col("_up").alias("_root"))
        else:
            later = roots.select(F.col("_node").alias("_root"), "_up")
            names = names.join(later, "_root", "left").select("_node", F.coalesce("_up", "_root").alias("_root"))
    names = written(names, "components-roots")
    least = names.groupBy("_root").agg(F.min("_node").alias("_comp"))
    return written(names.join(least, "_root").select("_node", "_comp"), "components")


def _between(edges: DataFrame) -> DataFrame:
    """Each edge of two nodes once, the lesser node first."""
    once = edges.where("_x <> _y").select(F.least("_x", "_y").alias("_x"), F.greatest("_x", "_y").alias("_y")).distinct()
    return written(once, "components-edges")


def _roots(edges: DataFrame) -> DataFrame:
    """Nodes with the root of their tree: _node, _up."""
    both = edges.unionByName(edges.select(F.col("_y").alias("_x"), F.col("_x").alias("_y")))
    ups = written(both.groupBy(F.col("_x").alias("_node")).agg(F.min("_y").alias("_up")), "components-up")
    # The only circles of these pointers are two nodes that point to each other; the lesser one is the root.
    up = F.when(F.col("_far") == F.col("_node"), F.least("_node", "_up")).otherwise(F.col("_up"))
    ups = written(_followed(ups).select("_node", up.alias("_up")), "components-trees")
    while True:
        far = written(_followed(ups), "components-jump")
        if far.where("_far <> _up").isEmpty():
            return ups
        ups = far.select("_node", F.col("_far").alias("_up"))


def _followed(ups: DataFrame) -> DataFrame:
    return ups.join(ups.select(F.col("_node").alias("_up"), F.col("_up").alias("_far")), "_up").select("_node", "_up", "_far")
