"""Connected components of a graph given as a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """links(a, b) -> (node, component): for each node with a link, the smallest node that it reaches.

    In each round a node takes the smallest label among itself and its neighbours, then that label's own label, and
    the graph of the labels that are still linked is the next round's. Nodes that merge are gone, so a round at least
    halves what is left on a path, and links shrink from round to round. Nothing but "is it empty" comes to the
    driver; each round is written to the shared folder, so that a lost executor costs one round at most.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-links")
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        near = edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select("a", F.col("a").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
        labels = written(near.join(near.select(F.col("node").alias("label"), F.col("label").alias("further")), "label").select("node", F.col("further").alias("label")), name)
        rounds.append(labels)
        of_a, of_b = labels.toDF("a", "label_a"), labels.toDF("b", "label_b")
        joined = edges.join(of_a, "a").join(of_b, "b").select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b"))
        edges = written(joined.where("a < b").distinct(), f"{name}-links")
    found = rounds[0].toDF("node", "component")
    for labels in rounds[1:]:
        found = found.join(labels.toDF("component", "label"), "component", "left").select("node", F.coalesce("label", "component").alias("component"))
    return written(found, name)
