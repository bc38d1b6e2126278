"""Connected components of a graph that no single machine need hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch


#: Rounds that take the nodes in the order of their numbers, in which stars and dense groups collapse at once.
PLAIN = 2


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Labels the nodes of an undirected graph by contraction.

    ``edges`` has long columns a and b, a <> b. In each round every node points
    at the first of its neighbours and itself, and the edges are renamed to what
    their ends point at. After ``PLAIN`` rounds the nodes' order is a hash of their
    numbers and the round: whatever the graph's shape, a part of the nodes that
    doesn't depend on their number is expected to go in each round, so the
    rounds grow as the logarithm of the nodes. Only written tables meet in the
    joins, so that a hub's rows can be split among tasks.

    Returns (node, label) for the nodes with edges; equal labels mean the same
    component. No edges: no rows.
    """
    left = scratch.save(edges.distinct(), "edges0")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        k = len(rounds)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("a", "u")
        if k < PLAIN:
            least = both.groupBy("u").agg(F.min("b").alias("p")).where("p < u")
        else:
            place = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
            least = both.groupBy("u").agg(F.min(place("b")).alias("m")).where(F.col("m") < place("u")).select("u", F.col("m.n").alias("p"))
        to = scratch.save(least, f"to{k}")
        a, b = (to.select(F.col("u").alias(f"u{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
        named = left.join(a, left.a == a.ua, "left").join(b, left.b == b.ub, "left")
        named = named.select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")).where("x <> y")
        named = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = scratch.save(named, f"edges{k + 1}")
        rounds.append(to)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    nodes = scratch.spark.read.parquet(f"{scratch.path}/edges0")
    nodes = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    out = nodes.select("node", F.col("node").alias("label"))
    for k, to in enumerate(rounds):
        out = out.join(to, out.label == to.u, "left").select("node", F.coalesce("p", "label").alias("label"))
        out = scratch.save(out, f"labels{k}")
    return out
