"""Work on the files of a growing folder, each once: a stream's checkpoint knows what is done, so nothing is listed or joined with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files are known by path for as long as the checkpoint lives, however old they are.
_EVER = "36500d"


def stream_files(spark: SparkSession, folder: str, glob: str, files_a_batch: int = 100_000) -> DataFrame:
    """(path, content) of the files below a folder as a stream. Empty files have no row, as in Spark's other readers."""
    read = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    read = read.option("maxFilesPerTrigger", files_a_batch).option("maxFileAge", _EVER)
    return read.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "content")


def stream_lines(spark: SparkSession, folder: str, glob: str, files_a_batch: int = 100_000) -> DataFrame:
    """lines(path, line_no, line) of small files as a stream, for the parsers of `sources`."""
    text = F.split(F.decode("content", "UTF-8"), r"\r?\n")
    lines = stream_files(spark, folder, glob, files_a_batch).select("path", F.posexplode(text).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


def stream_packed(spark: SparkSession, folder: str, packs_a_batch: int = 1000) -> DataFrame:
    """(path, content) of the files that sources.files.write_packed() adds to a folder, as a stream. The driver knows packs, not the files in
    them, so arrivals may be many more than it could list."""
    read = spark.readStream.schema("path string, content binary").option("pathGlobFilter", "*.parquet")
    return read.option("maxFilesPerTrigger", packs_a_batch).option("maxFileAge", _EVER).parquet(folder)


def process_new(stream: DataFrame, job: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> DataFrame:
    """Run `job` on what the stream has that no earlier call with this checkpoint finished; all results so far, with their `batch`.

    A batch's files and number are noted before it starts and its results replace what an interrupted attempt left, so after a
    failure, however late, the next call does the same files again and each file's results are there once. A file that changes
    keeps its first results. Without files there is no result and an empty frame of no columns.
    """
    spark = stream.sparkSession

    def one(rows: DataFrame, batch: int) -> None:
        job(rows).write.mode("overwrite").parquet(f"{output}/batch={batch}")

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(output)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.range(0).drop("id")
    return spark.read.option("basePath", output).parquet(output)
