"""A corpus pipeline of five stages, each on all that the one before it kept.

Null and empty texts and texts below ten words fail the quality rules and go in the first stage. Null ids and repeated rows
are documents of their own, except that equal rows of one id and text count as copies in the third stage: one stays. Ties
go by doc_id (nulls last), then by a hash of the text or row, so reruns agree. Extra columns are carried along; the last
stage adds `size`, `source_size`, `target` and `taken`, in place of columns of these names. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldgrid.llm import decontaminate, jaccard, lines, mixing, quality
from foldgrid.llm.shared import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that repeat an earlier run go, and with them documents that consist of nothing else."""
    return lines.dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that five-word shingles at a Jaccard similarity of 0.8 or more link."""
    return jaccard.keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with `size` in words and the words `taken`, repeats counted."""
    mixed = mixing.mix(docs).where("taken > 0")
    added = ["size", "source_size", "target", "taken"]
    return mixed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], *added)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: Expectation-maximisation, fingerprints and flows aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
