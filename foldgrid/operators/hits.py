"""Hits of structure aligners: directions, best scores, cuts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def both_directions(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, tm1, tm2, line_no) as directed hits: a to b with tm1, b to a with tm2.

    A hit given more than once keeps its last score and its first place. Lines are numbers, or structs that sort as lines do.
    """
    numbers = isinstance(pairs.schema["line_no"].dataType, NumericType)
    line = lambda side: F.col("line_no") * 2 + side if numbers else F.struct("line_no", F.lit(side).alias("side"))
    two = F.array(
        F.struct(F.col("a").alias("query"), F.col("b").alias("target"), F.col("tm1").alias("score"), line(0).alias("line_no")),
        F.struct(F.col("b").alias("query"), F.col("a").alias("target"), F.col("tm2").alias("score"), line(1).alias("line_no")),
    )
    directed = pairs.select(F.inline(two))
    return directed.groupBy("query", "target").agg(F.max_by("score", "line_no").alias("score"), F.min("line_no").alias("line_no"))


def best_score(hits: DataFrame) -> DataFrame:
    """Highest score of each query and target, at the place where the pair comes first."""
    return hits.groupBy("query", "target").agg(F.max("score").alias("score"), F.min("line_no").alias("line_no"))


def top_k_aligner(hits: DataFrame, k: int, drop_self: bool = False) -> DataFrame:
    """The k best targets of each query; ties in order of appearance."""
    rows = hits.where("query != target") if drop_self else hits
    order = Window.partitionBy("query").orderBy(F.col("score").desc_nulls_last(), "line_no")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usalign_v1_list(hits: DataFrame, k: int) -> DataFrame:
    """Each query itself at rank 1, then its k - 1 best targets."""
    best = top_k_aligner(hits, k - 1).select("query", "target", "score", (F.col("rank") + 1).alias("rank"))
    own = hits.select("query").distinct().select("query", F.col("query").alias("target"), F.lit(None).cast("double").alias("score"), F.lit(1).alias("rank"))
    return own.unionByName(best)


def distinct_targets(hits: DataFrame) -> DataFrame:
    return hits.select("target").distinct()


def all_methods(tables: dict[str, DataFrame]) -> DataFrame:
    """One hits table (method, query, rank, target, score) of several methods."""
    rows = [df.select(F.lit(name).alias("method"), "query", "rank", "target", F.col("score").cast("double").alias("score")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def score_profile(df: DataFrame, column: str = "score") -> DataFrame:
    """Count, least, greatest, mean and zeros of a column's numbers; what is no number is passed over."""
    x = F.col(column).try_cast("double")
    return df.select(x.alias("x")).where("x IS NOT NULL").agg(
        F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.avg("x").alias("mean"), F.count_if(F.col("x") == 0).alias("zeros")
    )


def target_coverage(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct targets, how many of them are labelled, and the percentage."""
    known = labels.select(F.col("id").alias("target"), F.lit(1).alias("known")).distinct()
    joined = distinct_targets(hits).join(known, "target", "left")
    n, hit = F.count(F.lit(1)), F.count("known")
    return joined.agg(n.alias("targets"), hit.alias("labelled"), F.when(n > 0, 100.0 * hit / n).otherwise(0.0).alias("percent"))
