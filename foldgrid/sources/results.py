"""Search results, reports and embeddings, and the ranked outputs of structure aligners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import hits as H
from .structures import read_lines


def parse_gtalign(lines: DataFrame, k: int) -> DataFrame:
    """Hits of rank reports, lines(path, line_no, line): rank 1 (the query) and ranks beyond k + 1 go, the first k of the
    rest stay; the target is empty where the line has no domain id."""
    rank = F.regexp_extract("line", r"^\s+(\d+)\s+\S", 1).try_cast("int")
    rows = lines.select(ids.basename(F.col("path")).alias("file"), "line_no", rank.alias("given"), F.regexp_extract("line", r"/(d\w+?)\.ent", 1).alias("target"))
    rows = rows.where((F.col("given") > 1) & (F.col("given") <= k + 1))
    order = Window.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.select(ids.gtalign_query_id(F.col("file")).alias("query"), "rank", "target", F.lit(None).cast("double").alias("score"))


def read_gtalign(spark: SparkSession, path: str, k: int) -> DataFrame:
    return parse_gtalign(read_lines(spark, path, "*.out"), k)


def parse_gtalign_v1(lines: DataFrame, k: int) -> DataFrame:
    """k lines of each file from the first that starts with rank 1 (from the file's start when none does), the query
    itself among them; empty where a line has no domain id. Ids are PDB_CHAIN."""
    file = ids.basename(F.col("path"))
    first = lines.groupBy("path").agg(F.coalesce(F.min(F.when(F.col("line").startswith("     1 "), F.col("line_no"))), F.lit(0)).alias("first"))
    rows = lines.join(first, "path").where((F.col("line_no") >= F.col("first")) & (F.col("line_no") < F.col("first") + k))
    sid = F.upper(F.regexp_extract("line", r"/d(.*?)\.ent", 1))
    target = F.when(F.length(sid) >= 5, F.concat(F.substring(sid, 1, 4), F.lit("_"), F.substring(sid, 5, 1))).otherwise("")
    return rows.select(ids.pdb_chain(file).alias("query"), (F.col("line_no") - F.col("first") + 1).cast("int").alias("rank"), target.alias("target"))


def gtalign_v1_list(spark: SparkSession, path: str, k: int) -> DataFrame:
    return parse_gtalign_v1(read_lines(spark, path, "*.out"), k)


#: Lines of a file block beyond which their numbers would run into the next one's.
_LINES = 1 << 33


def with_appearance(rows: DataFrame) -> DataFrame:
    """Rows of a text source with `line_no`, a number that puts files in order of their names, then blocks and lines as they stand,
    however Spark packs them into tasks. Straight on the source; reads it once more for the names of its files.

    A number, as sums over groups with a struct of names would have to sort all rows.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    blocks = rows.select(block.alias("_block")).distinct()
    order = blocks.select("_block", (F.row_number().over(Window.orderBy("_block")) - 1).cast("long").alias("_nth"))
    numbered = rows.select("*", block.alias("_block"), F.monotonically_increasing_id().alias("_id"))
    joined = numbered.join(F.broadcast(order), "_block")  # a row a block of files, as many as tasks
    return joined.withColumn("line_no", F.col("_nth") * _LINES + F.col("_id") % _LINES).drop("_block", "_nth", "_id")


def usalign_hits(pairs: DataFrame, k: int) -> DataFrame:
    """k best hits of pairs(a, b, tm1, tm2, line_no) in both directions."""
    return H.top_k_aligner(H.both_directions(pairs), k)


def read_usalign(spark: SparkSession, path: str, k: int) -> DataFrame:
    """A headed TSV of chain pairs with the scores of either side."""
    rows = with_appearance(spark.read.csv(path, sep="\t", header=True))
    a, b = ids.usalign_id(F.col("`#PDBchain1`")), ids.usalign_id(F.col("PDBchain2"))
    return usalign_hits(rows.select(a.alias("a"), b.alias("b"), F.col("TM1").try_cast("double").alias("tm1"), F.col("TM2").try_cast("double").alias("tm2"), "line_no"), k)


def foldseek_hits(rows: DataFrame, k: int) -> DataFrame:
    """k best hits of rows(query, target, score, line_no): ids cut, best score of a repeated pair, the query left out."""
    named = rows.select(ids.foldseek_id(F.col("query")).alias("query"), ids.foldseek_id(F.col("target")).alias("target"), F.col("score").try_cast("double").alias("score"), "line_no")
    return H.top_k_aligner(H.best_score(named), k, drop_self=True)


def read_foldseek(spark: SparkSession, path: str, k: int) -> DataFrame:
    rows = with_appearance(spark.read.csv(path, sep="\t", schema="query string, target string, score string"))
    return foldseek_hits(rows, k)


def long_hits(wide: DataFrame) -> DataFrame:
    """Hits of a wide table: a query column and one `target,score` cell a rank; ids are stems. Empty cells go."""
    query, *cells = wide.columns
    rows = wide.select(ids.stem(F.col(query)).alias("query"), F.posexplode(F.array(*[F.col(f"`{c}`") for c in cells])).alias("place", "cell")).where("cell IS NOT NULL AND cell != ''")
    return rows.select("query", (F.col("place") + 1).alias("rank"), ids.stem(ids.cell_target(F.col("cell"))).alias("target"), ids.cell_score(F.col("cell")).alias("score"))


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    return long_hits(spark.read.csv(path, sep="\t", header=True, quote=""))


def wide_hits(hits: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """query_image and the columns 0..k-1 of `target,score` cells; queries without hits get an empty row."""
    cells = hits.where(F.col("rank") <= k).withColumn("cell", ids.score_cell(F.col("target"), F.col("score")))
    wide = cells.groupBy("query").pivot("rank", list(range(1, k + 1))).agg(F.first("cell"))
    if queries is not None:
        wide = queries.select("query").distinct().join(wide, "query", "left")
    return wide.select(F.col("query").alias("query_image"), *[F.col(str(n + 1)).alias(str(n)) for n in range(k)])


def write_search_results(hits: DataFrame, path: str, k: int, queries: DataFrame | None = None) -> None:
    wide_hits(hits, k, queries).write.csv(path, sep="\t", header=True, quote="")


def similarity_report(hits: DataFrame) -> DataFrame:
    """value: one JSON object {query: [[target, score], ...]} a query, best first."""
    pair = F.struct("rank", F.to_json(F.array("target", F.col("score").cast("string"))).alias("p"))
    rows = hits.groupBy("query").agg(F.array_sort(F.collect_list(pair)).alias("h"))
    number = F.array_join(F.transform("h", lambda x: F.regexp_replace(x["p"], r',"([^"]*)"\]$', ",$1]")), ",")
    key = F.regexp_replace(F.to_json(F.array("query")), r"^\[|\]$", "")
    return rows.select(F.concat(F.lit("{"), key, F.lit(":["), number, F.lit("]}")).alias("value"))


def write_similarity_report(hits: DataFrame, path: str) -> None:
    similarity_report(hits).write.text(path)


def write_embeddings(emb: DataFrame, path: str) -> None:
    emb.select("item_id", "model", "vec").write.parquet(path)


def read_embeddings(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Stored embeddings; an error when they are of another model."""
    rows = spark.read.parquet(path)
    other = [r[0] for r in rows.select("model").distinct().limit(5).collect() if r[0] != model]
    if other:
        raise ValueError(f"{path}: embeddings of {other[0]}, not {model}")
    return rows
