"""Whole jobs: search with evaluation, structures to maps, annotated training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import energies, filters, images, maps, metrics, sampling, search


def evaluate_search(emb: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """Mean precision, average precision and recall at k by level of all-pairs cosine search."""
    hits = search.search_all(emb, k + 1)
    return metrics.mean_metrics(metrics.query_metrics(hits, labels, k))


def build_maps(residues: DataFrame, frame_atoms: DataFrame, low: int = 20, high: int = 200, cutoff: float = 10.0, digits: int = 6) -> DataFrame:
    """Pixels of every structure of acceptable length: distances, hydrophobicity and frame-averaged energies. Energies are rounded to
    `digits` places, so that pixels don't depend on the order in which terms were added."""
    sizes = filters.filter_length(residues.groupBy("structure_id").agg(F.count(F.lit(1)).cast("int").alias("n")), "n", low, high)
    kept = residues.join(sizes, "structure_id", "left_semi")
    atoms = frame_atoms.join(sizes, "structure_id", "left_semi")
    mean = energies.frame_average(energies.frame_energies(atoms), energies.frame_counts(atoms))
    mean = mean.withColumns({t: rounded(F.col(t), digits) for t in energies.TERMS})
    return images.unpack_pixels(maps.map_images(kept, energies=mean, cutoff=cutoff))


def training_lists(ids: DataFrame, annotations: DataFrame, level: str, n: int, share: float, excluded: list[str], item: str = "id", seed: int = 42) -> DataFrame:
    """Class-balanced sample of the listed items, split by class into train and eval."""
    rows = filters.exclude_classes(annotations, level, excluded)
    sample = sampling.balanced_sample(ids, rows, level, n, item, seed)
    return sampling.stratified_split(sample, level, share, item, seed)
