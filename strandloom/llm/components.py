"""Connected components by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and root of every node with an edge to another; root is some node of its component.

    Each round every node moves to the neighbour (or itself) that comes first in an order drawn anew for the round,
    and the edges between the images remain. A round drops a constant share of the nodes on average whatever the
    shape (chains too), so rounds grow with the logarithm of the component size. State is written to the shared
    folder each round; only a row count and a flag reach the driver. All joins are sort-merged: planned by size, the
    labels of all rounds would be broadcast in one plan, and their tables stand in the driver together.
    """
    left = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "edges")
    steps: list[DataFrame] = []
    rounds = 0
    while left.take(1):
        both = left.union(left.select(F.col("b"), F.col("a")))
        order = lambda c: F.struct(F.xxhash64(F.lit(rounds), c), c.alias("to"))  # noqa: B023, E731
        best = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        move = materialise(best.select(F.col("a").alias("node"), F.least(F.col("m"), order(F.col("a")))["to"].alias("to")), "moves")
        steps.append(move)
        after = left.join(move.hint("merge"), left["a"] == move["node"]).select(F.col("to").alias("x"), "b")
        after = after.join(move.hint("merge"), after["b"] == move["node"]).select("x", F.col("to").alias("y")).where("x != y")
        left = materialise(after.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        rounds += 1
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[-1].withColumnRenamed("to", "root")
    for move in reversed(steps[:-1]):
        step = move.join(found.withColumnRenamed("node", "to").hint("merge"), "to", "left")
        found = step.select("node", F.coalesce("root", "to").alias("root"))
    return materialise(found, "roots")
