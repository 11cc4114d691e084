"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import ids

LEVELS = ("class", "fold", "superfamily", "family")


def with_levels(df: DataFrame, sccs: str = "sccs") -> DataFrame:
    """The four levels of a dotted classification as columns."""
    return df.withColumns({name: ids.level(F.col(sccs), n + 1) for n, name in enumerate(LEVELS)})


def exclude_classes(df: DataFrame, level: str, names: list[str]) -> DataFrame:
    """Rows whose class isn't among the names; rows without a class stay."""
    return df.where(F.col(level).isNull() | ~F.col(level).isin(names)) if names else df


def excluded_counts(df: DataFrame, level: str, names: list[str]) -> DataFrame:
    """One row for each name: how many rows it removes; 0 for names that the data doesn't have."""
    asked = df.sparkSession.createDataFrame([(n,) for n in names], "name string")
    found = df.groupBy(F.col(level).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("removed"))


def exclude_items_by_class(items: DataFrame, cla: DataFrame, names: list[str], item: str = "sid") -> DataFrame:
    """Items whose domain isn't of an excluded class; items without a class stay."""
    out = cla.where(ids.level(F.col("sccs"), 1).isin(names)).select(F.col("sid").alias("excluded")).distinct()
    return items.join(out, items[item] == out["excluded"], "left_anti")


def length_ok(length: Column, low: int = 20, high: int = 200, inclusive: bool = True) -> Column:
    return (length >= low) & ((length <= high) if inclusive else (length < high))


def filter_length(df: DataFrame, length: str, low: int = 20, high: int = 200, inclusive: bool = True) -> DataFrame:
    return df.where(length_ok(F.col(length), low, high, inclusive))


def length_report(df: DataFrame, length: str, low: int = 20, high: int = 200, inclusive: bool = True) -> DataFrame:
    ok = length_ok(F.col(length), low, high, inclusive)
    return df.agg(F.count_if(ok).alias("kept"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("out_of_range"))


def filter_min_image(images: DataFrame, px: int = 20) -> DataFrame:
    return images.where((F.col("image.width") >= px) & (F.col("image.height") >= px))


def select_chain(atoms: DataFrame, chain: str = "first") -> DataFrame:
    """Atoms of one chain, or of the first chain of each structure in file order."""
    if chain != "first":
        return atoms.where(F.col("chain") == chain)
    first = F.min_by("chain", "line_no").over(Window.partitionBy("structure_id"))
    return atoms.withColumn("first_chain", first).where("structure_id IS NOT NULL AND chain <=> first_chain").drop("first_chain")


def letter_chains(df: DataFrame, sid: str = "sid") -> DataFrame:
    return df.where(ids.has_letter_chain(F.col(sid)))


def sample_frames(frames: DataFrame, interval: int = 10_000) -> DataFrame:
    """Every interval-th step, the start left out."""
    return frames.where((F.col("step") > 0) & (F.col("step") % interval == 0))


def atom_kind(res_name: Column, is_protein: Column) -> Column:
    """protein, solvent or ion; unknown residues count as solvent."""
    name = F.upper(F.trim(res_name))
    return F.when(is_protein, "protein").when(name.isin(*K.SOLVENT_NAMES), "solvent").when(name.isin(*K.ION_NAMES), "ion").otherwise("solvent")


def strip_solvent(atoms: DataFrame) -> DataFrame:
    return atoms.where(~F.upper(F.trim(F.col("res_name"))).isin(*K.STRIPPED_NAMES))


def triage_queries(metrics: DataFrame, level: str = "superfamily", low: float = 0.2) -> DataFrame:
    """Queries of a level with a share of matches of at most `low` (bad) or of 1 (good)."""
    share = F.col("tp") / F.col("valid")
    verdict = F.when(share <= low, "bad").when(share == 1, "good")
    return metrics.where((F.col("level") == level) & (F.col("valid") > 0)).withColumn("verdict", verdict).where("verdict IS NOT NULL")


def triage_queries_v1(metrics: DataFrame, k: int, level: str = "fold") -> DataFrame:
    """Queries with exactly a fifth (bad) or all (good) of k matching."""
    share = F.col("tp") / k
    verdict = F.when(share == 0.2, "bad").when(share == 1.0, "good")
    return metrics.where(F.col("level") == level).withColumn("verdict", verdict).where("verdict IS NOT NULL")


def finite_positions(atoms: DataFrame) -> DataFrame:
    """structure_id, frame, finite: whether all coordinates of a frame are numbers."""
    good = F.lit(True)
    for c in ("x", "y", "z"):
        good = good & F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.lit(False))
    return atoms.groupBy("structure_id", "frame").agg(F.bool_and(good).alias("finite"))
