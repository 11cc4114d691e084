"""Scratch tables, and ranks within groups of any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where none is set, a temporary one on a local master, and an error on a
    cluster, whose machines don't share their folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back."""
    path = f"{scratch_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def single_row(df: DataFrame) -> DataFrame:
    """A frame of one row at most; running it over more fails."""
    held = df.groupBy().agg(F.collect_list(F.struct(*df.columns)).alias("r"))
    several = F.raise_error(F.lit("one row expected, got several")).cast(held.schema["r"].dataType)
    return held.select(F.inline(F.when(F.size("r") > 1, several).otherwise(F.col("r"))))


def seeded(item: Column, seed: int) -> Column:
    """A hash that orders items at random, the same on every run and in any SQL engine."""
    return F.md5(F.concat_ws("|", item.cast("string"), F.lit(str(seed))))


def grouped_rank(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with _rank (1-based, by `order`) and _n (rows) of their group, however large a group is.

    Rows are dealt out by ranges of group and order; only the counts by group and range are put in line, so a group
    that fills many ranges is ranked by many tasks.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, as ranges are drawn from a sample and may differ when they are drawn again
    ranged = materialize(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    line = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select(
        *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)],
        F.col("_part").alias("_p"),
        (F.sum("_c").over(line) - F.col("_c")).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*group)).alias("_n"),
    )
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    within = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    ranked = ranged.withColumn("_r", within).join(counts, same)
    return ranked.withColumn("_rank", F.col("_r") + F.col("_before")).drop("_part", "_p", "_r", "_before", *[f"_g{k}" for k in range(len(group))])


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their `rank`. Spark keeps the best n of each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)
