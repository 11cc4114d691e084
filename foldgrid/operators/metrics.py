"""Precision, average precision and recall at K on the levels of a classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import LEVELS
from .joins import attach_labels, first_labels


def relevant_counts(labels: DataFrame) -> DataFrame:
    """level, value, r: rows of each value at each level less one. Every row counts, also of repeated ids."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("value")) for c in LEVELS])).alias("x")
    return labels.select(each).select("x.*").where("value IS NOT NULL").groupBy("level", "value").agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("r"))


def running_precision(labelled: DataFrame, levels: tuple[str, ...] = LEVELS, compact: bool = True) -> DataFrame:
    """Labelled hits with k (rank among the labelled ones, or the raw rank), and for each level match, running matches
    and their share of k."""
    order = Window.partitionBy("query").orderBy("rank", "target")
    out = labelled.withColumn("k", F.row_number().over(order) if compact else F.col("rank"))
    for c in levels:
        out = out.withColumn(f"m_{c}", F.coalesce(F.col(f"q_{c}") == F.col(f"t_{c}"), F.lit(False)).cast("int"))
        out = out.withColumn(f"tp_{c}", F.sum(f"m_{c}").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return out


def _by_level(rows: DataFrame) -> DataFrame:
    """Matches and the sum of precisions at matches for each query and level, from one shuffle by query."""
    sums = []
    for c in LEVELS:
        at = F.when(F.col(f"m_{c}") == 1, F.col(f"tp_{c}") / F.col("k")).otherwise(0.0)
        sums += [F.sum(f"m_{c}").alias(f"tp_{c}"), F.sum(at).alias(f"sum_{c}"), F.first(f"q_{c}").alias(f"v_{c}")]
    wide = rows.groupBy("query").agg(F.count(F.lit(1)).alias("valid"), *sums)
    each: list[Column] = [
        F.struct(F.lit(c).alias("level"), F.col(f"v_{c}").alias("value"), F.col(f"tp_{c}").alias("tp"), F.col(f"sum_{c}").alias("precisions")) for c in LEVELS
    ]
    return wide.select("query", "valid", F.explode(F.array(*each)).alias("x")).select("query", "valid", "x.*")


def query_metrics(hits: DataFrame, labels: DataFrame, k: int = 5, order: str | None = None) -> DataFrame:
    """query, level, tp, valid, r, patk, apk, ratk. The self-hit is left out by name; unlabelled targets don't count as
    ranks; precision is of k, average precision of min(r, k), recall of r; all are 0 where r is 0."""
    labelled = attach_labels(hits.where("query != target"), labels, order)
    rows = _by_level(running_precision(labelled).where(F.col("k") <= k))
    rows = rows.join(relevant_counts(labels), ["level", "value"], "left").withColumn("r", F.coalesce("r", F.lit(0)))
    some = F.col("r") > 0
    return rows.select(
        "query",
        "level",
        "value",
        F.col("tp").cast("int").alias("tp"),
        F.col("valid").cast("int").alias("valid"),
        F.col("r").cast("int").alias("r"),
        F.when(some, F.col("tp") / k).otherwise(0.0).alias("patk"),
        F.when(some, F.col("precisions") / F.least("r", F.lit(k))).otherwise(0.0).alias("apk"),
        F.when(some, F.col("tp") / F.col("r")).otherwise(0.0).alias("ratk"),
    )


def query_metrics_v1(hits: DataFrame, labels: DataFrame, k: int = 5, order: str | None = None) -> DataFrame:
    """query, level, tp, patk, apk by the older rules: the self-hit counts, ranks are raw, average precision is of the
    matches and null where there are none. Unlabelled targets match nothing."""
    first = first_labels(labels, "id", order)
    q = first.select(F.col("id").alias("query"), *[F.col(c).alias(f"q_{c}") for c in LEVELS])
    t = first.select(F.col("id").alias("target"), *[F.col(c).alias(f"t_{c}") for c in LEVELS])
    labelled = hits.where(F.col("rank") <= k).join(q, "query").join(t, "target", "left")
    rows = _by_level(running_precision(labelled, compact=False))
    return rows.select(
        "query", "level", F.col("tp").cast("int").alias("tp"), (F.col("tp") / k).alias("patk"), F.when(F.col("tp") > 0, F.col("precisions") / F.col("tp")).alias("apk")
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over queries by level, and how many queries were scored and how many had nothing relevant to find."""
    return metrics.groupBy("level").agg(
        F.avg("patk").alias("patk"), F.avg("apk").alias("mapk"), F.avg("ratk").alias("ratk"), F.count(F.lit(1)).alias("scored"), F.count_if(F.col("r") == 0).alias("without_relevant")
    )


def skipped_queries(hits: DataFrame, metrics: DataFrame) -> DataFrame:
    """Queries of the hits that got no score."""
    return hits.select("query").distinct().join(metrics.select("query").distinct(), "query", "left_anti")


def compare_methods(means: dict[str, DataFrame]) -> DataFrame:
    """metric, method and one column a level."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("method", F.lit(name)) for name, df in means.items()])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("score")) for c in ("patk", "mapk", "ratk")])).alias("x")
    return rows.select("method", "level", each).select("method", "level", "x.*").groupBy("metric", "method").pivot("level", list(LEVELS)).agg(F.first("score"))


def distinct_per_column(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(c) for c in df.columns])


def unknown_names(names: list[str], df: DataFrame, column: str) -> DataFrame:
    """Names that the data doesn't have."""
    asked = df.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")
    return asked.distinct().subtract(df.select(F.col(column).cast("string").alias(column)))


def unseen_classes(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Classes of the data that training doesn't have."""
    return df.select(column).subtract(train.select(column))
