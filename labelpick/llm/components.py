"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpick.llm.common import materialize


def _roots(hooks: DataFrame) -> DataFrame:
    """Follow (node, up), up < node, to the end: (node, up) where no ``up`` has a further one. Depth halves per round."""
    while True:
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("further"))
        jumped = materialize(hooks.join(above, "up", "left").select(
            "node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "roots")
        hooks = jumped.select("node", "up")
        if not jumped.where("moved").limit(1).count():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the edges (a, b); the component is its smallest node.

    Every node hooks to its smallest neighbour if that is smaller, chains are followed to their ends, and edges between
    the ends form the next, smaller graph. Every stage is a stored table, so no lineage grows and no node is collected.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = None
    while True:
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        roots = _roots(materialize(hooks, "hooks"))
        if labels is None:
            labels = nodes.join(roots, "node", "left").select("node", F.coalesce("up", "node").alias("component"))
        else:
            labels = labels.join(roots.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("up", "component").alias("component"))
        labels = materialize(labels, "labels")
        left = edges.join(roots.select(F.col("node").alias("a"), F.col("up").alias("a_up")), "a", "left")
        both = left.join(roots.select(F.col("node").alias("b"), F.col("up").alias("b_up")), "b", "left")
        ends = both.select(F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b")).where("a <> b")
        edges = materialize(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return labels
