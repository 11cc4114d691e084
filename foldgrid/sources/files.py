"""Small files, one a row: in a folder, or many of them packed in a few large ones."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_files(files: DataFrame, folder: str) -> int:
    """Write files(path string, content binary) below a folder that all machines share; how many there are.

    Contents are written out of their batch one by one, none of it is copied. Each is written under a name of its own and then moved into place, so a task that runs again leaves whole files. Of
    a path given more than once, one content stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                target = posixpath.join(root, path)
                part = posixpath.join(posixpath.dirname(target), f".{uuid.uuid4().hex}")
                store.create_dir(posixpath.dirname(target), recursive=True)
                with store.open_output_stream(part) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                store.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


#: Bytes that a writer gathers, and a reader holds at once, of packed contents.
PACK = 16_000_000


def write_packed(files: DataFrame, folder: str) -> None:
    """Add files(path string, content binary), each of a path of its own, to a folder as rows of Parquet files. A driver lists every file
    that it reads, and keeps the list: millions of small ones don't fit it, the packs of them do."""
    rows = files.select("path", F.col("content").cast("binary"))
    rows.write.mode("append").option("compression", "zstd").option("parquet.block.size", PACK).parquet(folder)


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """files(path, content) that write_packed() has put there."""
    return spark.read.schema("path string, content binary").parquet(folder)
