"""Connected components of an edge table, by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component: smallest node reached.

    Each round gives every node its smallest neighbour as parent, shortens the
    parent paths twice, and contracts the edges; edges inside a component
    vanish, so the table shrinks until it is empty.  Null ends and loops make
    no edge.  Every round is written to the shared folder.
    """
    def pairs(a, b):
        return (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))

    e = materialise(edges.where("a <> b").select(*pairs(F.col("a"), F.col("b"))).distinct(), "edges")
    labels = e.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not e.isEmpty():
        parent = e.groupBy("u").agg(F.min("v").alias("p"))
        for _ in range(2):
            parent = materialise(parent, "parent")
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        parent = materialise(parent, "parent")
        labels = materialise(
            labels.join(parent.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        for end in ("u", "v"):
            other = "v" if end == "u" else "u"
            e = e.join(parent.select(F.col("u").alias(end), "p"), end, "left").select(F.coalesce("p", end).alias(end), other)
        e = materialise(e.where("u <> v").select(*pairs(F.col("u"), F.col("v"))).distinct(), "edges")
    return labels
