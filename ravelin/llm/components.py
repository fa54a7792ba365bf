"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import forget, kept_table


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b): label is the smallest node that can be reached.

    In each round every node hooks to its smallest neighbour, hooks are followed twice, and links are contracted to
    what remains between different labels. Each round at least halves the nodes of a component that isn't done.
    """
    edges = kept_table(links.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "links")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = kept_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "hooks")
        for _ in range(2):
            onward = hook.select(F.col("node").alias("to"), F.col("to").alias("further"))
            last, hook = hook, kept_table(hook.join(onward, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "hooks")
            forget(last)
        to = hook.select(F.col("node").alias("label"), "to")
        labels = kept_table(labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        at_a = hook.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        at_b = hook.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        done, edges = edges, edges.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        last, edges = done, kept_table(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "links")
        forget(last, hook)
    return labels


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels(node, label) after further links between nodes; nodes without a label are their own."""
    at = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    bt = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = more.join(at, "a", "left").join(bt, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    top = components(between).select(F.col("node").alias("label"), F.col("label").alias("over"))
    fresh = top.join(labels.select(F.col("label")).distinct(), "label", "left_anti").select(F.col("label").alias("node"), F.col("over").alias("label"))
    moved = labels.join(top, "label", "left").select("node", F.coalesce("over", "label").alias("label"))
    return kept_table(moved.unionByName(fresh), "labels")
