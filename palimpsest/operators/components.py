"""Connected components of an edge table, by contraction, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the least node.

    Each round every node points at its least neighbour; the pointers are
    doubled until they rest on roots; edges are redrawn between roots.  What
    remains at least halves each round.  Minima are added up before the
    shuffle, so a node with very many neighbours costs no single task, and
    joins on it are those that adaptive execution can split.
    """
    edges = materialize(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "edges")
    both = edges.select("a").union(edges.select("b")).distinct()
    labels = materialize(both.select(F.col("a").alias("node"), F.col("a").alias("root")), "labels")
    while not edges.isEmpty():
        point = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        point = materialize(point, "pointers")
        while True:
            far = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            ahead = materialize(
                point.join(far, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")),
                "pointers",
            )
            moved = not ahead.where("moved").isEmpty()
            point = ahead.drop("moved")
            if not moved:
                break
        labels = materialize(
            labels.join(point.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")),
            "labels",
        )
        for end in ("a", "b"):
            edges = edges.join(point.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = materialize(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "edges")
    return labels
