"""Connected components of a distributed edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, label) of every node of ``edges`` (u, v); the label is the same for a component's nodes.

    Each round sends every node to its smallest neighbour (two hops on), then contracts the edges. Hubs
    are reduced before the shuffle. Rounds grow with the logarithm of a component's width; every round
    is a written table.
    """
    now = stored(edges.where("u <> v").selectExpr("least(u, v) AS u", "greatest(u, v) AS v").distinct(), folder, f"{name}_edges")
    labels, k = None, 0
    while True:
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        to = both.groupBy("u").agg(F.min("v").alias("v")).selectExpr("u AS node", "least(u, v) AS hop")
        to = stored(to.join(to.selectExpr("node AS hop", "hop AS far"), "hop").selectExpr("node", "far AS hop"), folder, f"{name}_to_{k}")
        if labels is None:
            labels = to.selectExpr("node", "hop AS label")
        else:
            labels = stored(labels.join(to.selectExpr("node AS label", "hop"), "label", "left").selectExpr("node", "coalesce(hop, label) AS label"), folder, f"{name}_labels_{k}")
        ends = now.join(to.selectExpr("node AS u", "hop AS a"), "u").join(to.selectExpr("node AS v", "hop AS b"), "v")
        now = stored(ends.where("a <> b").selectExpr("least(a, b) AS u", "greatest(a, b) AS v").distinct(), folder, f"{name}_edges_{k}")
        if now.isEmpty():
            return labels
        k += 1
