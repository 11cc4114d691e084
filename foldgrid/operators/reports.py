"""Reports on predictions(id, label, probs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import argmax


def with_prediction(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("pred", argmax(F.col("probs")))


def confusion(predictions: DataFrame) -> DataFrame:
    """label, pred, n: counts of every true and predicted class that meet."""
    return with_prediction(predictions).groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, classes: list[int]) -> DataFrame:
    return with_prediction(predictions).groupBy("label").pivot("pred", classes).agg(F.count(F.lit(1))).na.fill(0)


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall (accuracy of the class), F1 and support of each class, of their plain and weighted means
    (classes 'macro', 'weighted'), and the overall accuracy as the recall of 'accuracy'."""
    cells = confusion(predictions)
    true = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    got = cells.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    rows = true.join(got, "class", "full").na.fill(0, ["support", "tp", "predicted"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    rows = rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    share = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    three = ("precision", "recall", "f1")
    one = rows.agg(
        *[F.avg(c).alias(f"m_{c}") for c in three], *[share(c).alias(f"w_{c}") for c in three], F.sum("support").alias("support"), (F.sum("tp") / F.sum("support")).alias("accuracy")
    )
    line = lambda name, p, r, f: F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("support"))
    none = F.lit(None).cast("double")
    totals = one.select(
        F.inline(F.array(line("macro", *[F.col(f"m_{c}") for c in three]), line("weighted", *[F.col(f"w_{c}") for c in three]), line("accuracy", none, F.col("accuracy"), none)))
    )
    return rows.select(F.col("class").cast("string"), *three, "support").unionByName(totals)


#: Parts of a doubling of scores.
PARTS = 256


def _part(score: Column) -> Column:
    """Number of a range of scores, greater for greater scores: by the logarithm, so that small scores are told apart as well. Nulls
    are least and NaN is greatest, as in Spark's order."""
    size = F.log2(1 + F.abs(score) * (1 << 20)) * PARTS
    part = F.when(score < 0, -F.ceil(size)).otherwise(F.floor(size))
    top = 1 << 40
    return F.when(score.isNull(), F.lit(-top)).when(F.isnan(score), F.lit(top)).otherwise(F.greatest(F.least(part, F.lit(top - 1)), F.lit(1 - top))).cast("long")


def auc_ovr(predictions: DataFrame) -> DataFrame:
    """One-vs-rest AUC of each class with tie-averaged ranks; null for classes without rows on both sides.

    Scores are counted by (class, score) first, in each task and then together, so equal scores are one row however many there are.
    Counts by range of scores put in line give the rows before each range; the distinct scores of a range are ranked among
    themselves. No score is written or sampled, and a class is many tasks' work.
    """
    scores = predictions.select("label", F.posexplode("probs").alias("class", "score"))
    hit = F.count_if(F.col("label") == F.col("class"))
    counts = scores.groupBy("class", "score").agg(hit.alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("part", _part(F.col("score")))
    line = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("class", "part").agg(F.sum("n").alias("_n")).select("class", "part", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("before"))
    within = Window.partitionBy("class", "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts.hint("shuffle_hash"), ["class", "part"])
    rank = F.col("before") + F.col("_before") + (F.col("n") + 1) / 2  # of equal scores, the mean of their ranks
    sums = ranked.groupBy("class").agg(F.sum(rank * F.col("pos")).alias("ranks"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("pos")
    auc = (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * neg)
    return sums.select("class", F.when((F.col("pos") > 0) & (neg > 0), auc).alias("auc"), F.col("pos").alias("support"))


def auc_means(auc: DataFrame) -> DataFrame:
    rows = auc.where("auc IS NOT NULL")
    return rows.agg(F.avg("auc").alias("macro"), (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("weighted"))
