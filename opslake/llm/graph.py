"""Connected components of an edge table, by min-label hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.sources.sinks import materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, label) for every end of an edge; label = smallest id in the component.

    Each round hooks every vertex to its smallest smaller neighbour, follows
    these hooks to their roots by pointer jumping and replaces the ends of the
    edges by their roots.  Edges inside a tree vanish and parallel edges become
    one, so a hot group costs its edges once, and at least half of the vertices
    that still have edges leave in every round.  Hooks and edges are written to
    the shared folder; none is collected.  Null ends and self loops are ignored.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    first = e = materialize(_undirected(e), "cc-edges")
    trees = []
    while not e.isEmpty():
        tree = _roots(e.groupBy("u").agg(F.min("v").alias("root")))
        trees.append(tree)
        at_v = tree.withColumnsRenamed({"u": "v", "root": "root_v"})
        e = e.join(tree, "u").join(at_v, "v", "left").select(F.col("root").alias("u"), F.coalesce("root_v", "v").alias("v"))
        e = materialize(_undirected(e), "cc-edges")
    labels = first.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("label", F.col("id"))
    for tree in trees:
        up = tree.withColumnRenamed("u", "label")
        labels = labels.join(up, "label", "left").select("id", F.coalesce("root", "label").alias("label"))
    return materialize(labels, "cc-labels")


def _undirected(e: DataFrame) -> DataFrame:
    """Every edge once, from its larger end ``u`` to its smaller end ``v``."""
    return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _roots(hooks: DataFrame) -> DataFrame:
    """(u, root) from (u, root = a smaller vertex): the end of every chain of hooks, by jumps of doubling length."""
    while True:
        up = hooks.select(F.col("u").alias("root"), F.col("root").alias("up"))
        jumped = hooks.join(up, "root", "left").select("u", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        jumped = materialize(jumped, "cc-hooks")
        hooks = jumped.select("u", "root")
        if jumped.where("moved").isEmpty():
            return hooks
