"""Connected components of an edge table by joins: least neighbour labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for each node of edges (a, b), where label is the least node that it reaches.

    Each round takes the least label over the edges and then the label of that label, so paths shorten by
    half at least. Both joins read written tables, so that a hub's rows can be split at run time. Rounds end
    when no label changes. Nodes without edges are not listed. Tables of earlier rounds are deleted.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    labels = written(ends.groupBy("node").agg(F.least(F.min("to"), F.min("node")).alias("label")), f"{name}-labels")
    while True:
        at = labels.select(F.col("node").alias("to"), "label")
        told = ends.join(at, "to").select("node", "label", F.lit(None).cast("long").alias("was"))
        own = labels.select("node", "label", F.col("label").alias("was"))
        least = written(told.union(own).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")), f"{name}-least")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = written(least.join(up, "label").select("node", F.col("higher").alias("label"), "was"), f"{name}-labels")
        discard(labels, least)
        labels = jumped
        if jumped.where("label <> was").isEmpty():
            discard(edges)
            out = labels.select("node", "label")
            out.lumora_path = labels.lumora_path  # the caller may discard it
            return out
