"""Connected components of a match graph, distributed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, table: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, label) for every node of `edges` (a, b); label: the smallest node reachable.

    table(df, name) writes df to shared storage and reads it back. Each pass hooks every node to its
    smallest neighbour, follows the hooks twice, and contracts the graph; at least one node of every
    component with an edge goes each pass, and stars collapse at once. Ends when no edge between
    two labels is left. Nodes follow the hooks of all passes once, at the end.
    """
    e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    first, hooks = e, []
    while not e.isEmpty():
        hook = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        jump = hook.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        hook = table(hook.join(jump, "up", "left").select("node", F.coalesce("up2", "up").alias("up")), "hook")
        hooks.append(hook)
        a = hook.select(F.col("node").alias("a"), F.col("up").alias("pa"))
        b = hook.select(F.col("node").alias("b"), F.col("up").alias("pb"))
        moved = e.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b")
        e = table(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    for hook in hooks:
        labels = labels.join(hook.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return table(labels, "labels")


def grown_components(labels: DataFrame, edges: DataFrame, table: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """`labels` (node, label; labels are their own) after more `edges` (a, b) between labels, or nodes that have none yet."""
    met = connected_components(edges, table)
    every = labels.unionByName(met.select("node", F.col("node").alias("label"))).distinct()
    moved = met.select(F.col("node").alias("label"), F.col("label").alias("least"))
    return table(every.join(moved, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels")
