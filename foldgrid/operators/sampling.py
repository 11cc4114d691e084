"""Samples, splits, class weights and indexes. Random order is a seeded hash: the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped_rank, seeded, top_n


def ordered_split(df: DataFrame, label: str, order: str = "id", share: float = 0.8) -> DataFrame:
    """The first int(n * share) rows of each label as train, the rest as val."""
    ranked = grouped_rank(df, [label], [order])
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_n") * share), "train").otherwise("val")).drop("_rank", "_n")


def eval_sample(train: DataFrame, label: str, item: str = "id", share: float = 0.005, seed: int = 0) -> DataFrame:
    """max(1, int(share * n)) rows of each label, drawn without repeats."""
    ranked = grouped_rank(train.withColumn("_draw", seeded(F.col(item), seed)), [label], ["_draw", item])
    return ranked.where(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_draw", "_rank", "_n")


def balanced_sample(ids: DataFrame, annotations: DataFrame, label: str, n: int, item: str = "id", seed: int = 42) -> DataFrame:
    """Up to n annotated items of each class among the ids on the list."""
    rows = annotations.where(F.col(label).isNotNull()).join(ids.select(item).distinct(), item, "left_semi").select(item, label).distinct()
    draw = rows.withColumn("_draw", seeded(F.col(item), seed))
    return top_n(draw, [label], [F.col("_draw"), F.col(item)], n).drop("_draw", "rank")


def short_classes(sample: DataFrame, label: str, n: int) -> DataFrame:
    """Classes of which the sample has fewer than n."""
    return sample.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < n)


def stratified_split(sample: DataFrame, label: str, share: float, item: str = "id", seed: int = 42) -> DataFrame:
    """max(1, int(n * share)) rows of each class as eval, the rest as train."""
    ranked = grouped_rank(sample.withColumn("_draw", seeded(F.col(item), seed)), [label], ["_draw", item])
    evaluated = F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return ranked.withColumn("split", F.when(evaluated, "eval").otherwise("train")).drop("_draw", "_rank", "_n")


def chunk(df: DataFrame, parts: int, order: str = "id", group: list[str] | None = None) -> DataFrame:
    """Rows in contiguous parts of ceil(n / parts); the last parts may stay empty."""
    ranked = grouped_rank(df, group or [], [order])
    size = F.ceil(F.col("_n") / parts)
    return ranked.withColumn("part", (F.floor((F.col("_rank") - 1) / size) + 1).cast("int")).drop("_rank", "_n")


def random_split(df: DataFrame, share: float, item: str = "id", seed: int = 0, names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """max(1, int(n * share)) rows overall held out under the second name."""
    ranked = grouped_rank(df.withColumn("_draw", seeded(F.col(item), seed)), [], ["_draw", item])
    out = F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return ranked.withColumn("split", F.when(out, names[1]).otherwise(names[0])).drop("_draw", "_rank", "_n")


def label_index(df: DataFrame, label: str = "label") -> DataFrame:
    """label, label_idx: 0-based place of each class name in order. One row a class, put in line by one task: its work grows
    with the number of classes, not of rows."""
    names = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    return names.withColumn("label_idx", F.row_number().over(Window.orderBy("label")) - 1)


def class_summary(split: DataFrame, label: str = "label") -> DataFrame:
    """Rows of each class and overall (class 'ALL'), by split and in total."""
    one = lambda name: F.count_if(F.col("split") == name).alias(name)
    rows = split.rollup(label).agg(F.grouping(label).alias("_all"), F.count(F.lit(1)).alias("total"), one("train"), one("eval"))
    return rows.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(label).cast("string")).alias("class"), "total", "train", "eval")


def small_classes(df: DataFrame, label: str, n: int) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < n)


def drop_small_classes(df: DataFrame, label: str, n: int) -> DataFrame:
    """Rows of classes with n rows or more."""
    return df.join(small_classes(df, label, n).select(F.col(label).alias("_small")), F.col(label) == F.col("_small"), "left_anti")


def drop_half_empty_labels(split: DataFrame, label: str, names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """Rows of labels that have rows in both parts."""
    full = split.groupBy(F.col(label).alias("_full")).agg(*[F.count_if(F.col("split") == s).alias(f"_{s}") for s in names])
    full = full.where(" AND ".join(f"_{s} > 0" for s in names)).select("_full")
    return split.join(full, F.col(label) == F.col("_full"), "left_semi")


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight: 1 / rows of each class."""
    return train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", 1 / F.col("n"))


def with_weights(train: DataFrame, label: str = "label") -> DataFrame:
    weights = class_weights(train, label).select(F.col(label).alias("_label"), "weight")
    return train.join(weights, F.col(label) == F.col("_label")).drop("_label")


def resample_balanced(train: DataFrame, n: int, label: str = "label", item: str = "id", seed: int = 0) -> DataFrame:
    """n draws with replacement, every class equally likely, then every row of the class: draw, item and label.

    Draws are numbers hashed to a class and a place in it, joined to the rows by class and place.
    """
    index = label_index(train.withColumn("label", F.col(label).cast("string"))).withColumnRenamed("label", "_name")
    ranked = grouped_rank(train, [label], [item]).withColumn("_name", F.col(label).cast("string")).join(index, "_name")
    classes = index.agg(F.count(F.lit(1)).alias("_classes"))
    sizes = ranked.groupBy("label_idx").agg(F.max("_n").alias("_size"))
    drawn = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.lit(str(seed)), F.lit(str(salt)))), 1, 15), 16, 10)
    pick = lambda salt, of: drawn(salt).cast("long") % of
    draws = train.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(classes))
    draws = draws.withColumn("label_idx", pick(1, F.col("_classes")).cast("int")).join(sizes, "label_idx").withColumn("_rank", pick(2, F.col("_size")) + 1)
    return draws.join(ranked, ["label_idx", "_rank"]).select("draw", item, label)
