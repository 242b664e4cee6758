"""Connected components of a link table by contraction.

At each round every node draws a priority from a hash of its number and the round, and
points to the first of itself and its neighbours by priority; links then become links
between what their ends point to, and those that join a node with itself go.  About half of
the nodes go at each round whatever the shape of the graph, so a chain of n takes O(log n)
rounds.  Links and labels stay in tables; the driver learns only whether any link is left.
A hub with very many links costs one row a link: minima are taken before rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import Written, checkpointed


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) to (node, label): the least node of each component; nodes without links do not occur."""
    written = Written(links)
    links = links.where("a <> b").select("a", "b")
    edges = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("a").alias("label"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c), F.col(c).alias("to"))  # noqa: E731,B023
        points = written(edges.groupBy(F.col("a").alias("at")).agg(F.least(F.min(rank("a")), F.min(rank("b")))["to"].alias("to")))
        labels = written(labels.join(points, F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label")))
        moved = edges.join(points.toDF("a", "x"), "a").join(points.toDF("b", "y"), "b").where("x <> y")
        edges = written(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    out = checkpointed(labels.join(least, "label").select("node", F.col("least").alias("label")))
    written.forget(links.sparkSession)
    return out
