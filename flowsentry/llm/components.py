"""Connected components of links that no machine holds together: contraction in rounds over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsentry.plans.storage import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b), both long; the root is the smallest node that can be reached.

    In each round every node hooks on to its smallest smaller neighbour; links are then drawn between the
    hooks' ends, and those within one end vanish. Only links that are left are read again.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = materialize(links.select(*ends).filter("a < b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        for _ in range(2):
            hooks = materialize(hooks)
            on = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(on, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        hooks = materialize(hooks)
        labels = materialize(moved(labels, "root", hooks))
        edges = materialize(moved(moved(edges, "a", hooks), "b", hooks).filter("a != b").select(*ends).distinct())
    return labels


def moved(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """``df`` with ``column`` sent along ``hooks``."""
    h = hooks.select(F.col("node").alias(column), "to")
    rest = [c for c in df.columns if c != column]
    return df.join(h, column, "left").select(*rest, F.coalesce("to", column).alias(column))
