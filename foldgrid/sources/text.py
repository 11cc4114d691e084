"""Lists, classifications and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators.sampling import chunk

#: The annotation table's columns.
ANNOTATIONS = """SCOPeID string, PDBFileName string, ProteogramFileName string, PDBId string, ChainId string, PDBAndChainId string,
SCOPeClass string, SCOPeFold string, SCOPeSuperfamily string, SCOPeFamily string, PDBSequenceLength int, PDBDepositDate string,
PDBExperimentalMethod string, PDBMolecularWeight double, PDBDisulfideBond int, PDBProteinEntityCount int,
PDBIsTransmembrane boolean, PDBTransmembraneRegionCounts int, PDBeGOAnnotation string, PDBSequence string"""


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """id: first token of each line, without folder and .ent; blank lines are passed over."""
    first = F.regexp_extract(F.trim("value"), r"^(\S+)", 1)
    return spark.read.text(path).where(F.trim("value") != "").select(F.regexp_replace(ids.basename(first), r"\.ent$", "").alias("id"))


def read_classification(spark: SparkSession, path: str) -> DataFrame:
    """sid, sccs of lines with four fields or more; comments and blank lines are passed over."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(parts.alias("f")).where(F.size("f") >= 4)
    return rows.select(F.get("f", F.lit(0)).alias("sid"), F.get("f", F.lit(3)).alias("sccs"))


def read_cluster_list(spark: SparkSession, path: str) -> DataFrame:
    """id: between > and the first colon of each header line (else its first token)."""
    rows = spark.read.text(path).where(F.trim("value").startswith(">"))
    return rows.select(F.regexp_extract(F.trim("value"), r"^>\s*([^:\s]*)", 1).alias("id"))


def read_annotations(spark: SparkSession, path: str, level_col: str) -> DataFrame:
    """A headed TSV as it is; an error when it lacks the level's column."""
    header = spark.read.csv(path, sep="\t", header=True, quote="").columns
    if level_col not in header:
        raise ValueError(f"{path}: no column {level_col}; it has {', '.join(header)}")
    known = {x.split()[0]: x.split()[1] for x in ANNOTATIONS.replace("\n", " ").split(", ")}
    schema = ", ".join(f"`{c}` {known.get(c, 'string')}" for c in header)
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote="")


def write_annotations(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, quote="", emptyValue="", mode="overwrite")


def fasta(df: DataFrame, order: str) -> DataFrame:
    """value: header and sequence of each annotated row. Of equal headers the sequence of the row that is last by the column `order`
    stays; of several last ones, the greatest."""
    header = F.concat(F.lit(">"), F.col("PDBAndChainId"), F.lit("|"), F.col("SCOPeID"), F.lit("|"), F.col("SCOPeFamily"))
    one = df.groupBy(header.alias("h")).agg(F.max_by("PDBSequence", F.struct(order, "PDBSequence")).alias("s"))
    return one.select(F.concat("h", F.lit("\n"), "s").alias("value"))


def write_fasta(df: DataFrame, path: str, order: str) -> None:
    fasta(df, order).write.text(path)


def write_labelled_layout(df: DataFrame, path: str) -> None:
    """One folder for each split and label."""
    df.write.partitionBy("split", "label").parquet(path)


def write_split_lists(df: DataFrame, path: str, parts: int = 1) -> None:
    """Ids as text, a folder for each split and part."""
    rows = chunk(df, parts, "id", ["split"])
    rows.select(F.col("id").cast("string").alias("value"), "split", "part").write.partitionBy("split", "part").text(path)
