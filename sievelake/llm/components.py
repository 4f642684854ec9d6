"""Connected components of a table of links, with no step that gathers a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, spread_join, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b): the label is the smallest node that links reach from it.

    Each round takes the smallest label among a node and its neighbours, then follows labels twice
    (pointer jumping), so long chains halve; it ends when no label changes.  Labels are aggregated on the map side, and
    the joins deal the links of a node with very many, and the nodes of one large component, over several tasks.
    Links with a null side and links of a node with itself make no node; no links give an empty table.
    """
    scratch = Scratch(links.sparkSession, "components")
    edges = scratch(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "links")
    labels = scratch(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), "links"), "labels")
    while True:
        near = spread_join(edges, labels.select(F.col("node").alias("b"), "label", "links"), "b", "links", F.col("a")).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "links", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        new = scratch(new, "labels")
        for _ in range(2):
            # A label is a node, so it has a row of its own: the label's label, with the number of nodes that have it.
            sizes = new.groupBy("label").agg(F.count("*").alias("nodes"))
            step = scratch(sizes.join(new.select(F.col("node").alias("label"), F.col("label").alias("next")), "label"), "steps")
            new = spread_join(new, step, "label", "nodes", F.col("node")).select("node", "links", F.col("next").alias("label"), "was")
        new = scratch(new, "labels")
        if new.filter("label != was").isEmpty():
            out = stored(new.select("node", "label"), "labels")
            scratch.drop()
            return out
        labels = new.select("node", "label", "links")
