"""Connected components of an edge table, as repeated joins and minima; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a long, b long): root is the smallest node that links reach.

    Alternates two steps until nothing changes: each node hands its larger neighbours to the smallest one it knows,
    then its smaller neighbours and itself. Every step's edges go to the shared folder, so lineage stays short. The
    number of rounds grows with the logarithm of the longest path; edges never become more than they were. The minima
    by node are written before they are joined, so both sides of a join come straight from exchanges and Spark's
    adaptive skew join can split the neighbours of a hub. Runs one job or more a round.
    """
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.union(smallest.select("a", F.col("m").alias("b"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return materialize(roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
