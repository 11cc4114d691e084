"""Structure files of fixed columns, and image folders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from .files import PACK, read_packed
from .pictures import MODES, decode_png

#: First column and width of each field of an atom line.
FIELDS = {"record": (1, 6), "atom_name": (13, 4), "altloc": (17, 1), "res_name": (18, 3), "chain": (22, 1), "res_seq": (23, 4), "icode": (27, 1), "x": (31, 8), "y": (39, 8), "z": (47, 8), "occupancy": (55, 6)}
_TYPES = {"res_seq": "int", "x": "double", "y": "double", "z": "double", "occupancy": "double"}


def _is_atom(line: Column) -> Column:
    return line.startswith("ATOM  ") | line.startswith("HETATM")


def _fields(atoms: DataFrame) -> DataFrame:
    """atoms of lines(path, model, line_no, line)."""
    columns = {k: F.trim(F.substring("line", a, n)) for k, (a, n) in FIELDS.items()}
    columns = {k: c.try_cast(_TYPES[k]) if k in _TYPES else c for k, c in columns.items()}
    name = "structure_id" if "structure_id" in atoms.columns else ids.strip_structure_extension(F.col("path")).alias("structure_id")
    return atoms.select(name, F.coalesce("model", F.lit(1)).alias("model"), "line_no", *[c.alias(k) for k, c in columns.items()])


def parse_atoms(lines: DataFrame) -> DataFrame:
    """atoms of lines(path, line_no, line): ATOM and HETATM lines of each file's first model. Lines are read once and exchanged by file;
    whole files are better taken by parse_files()."""
    marks = F.col("line").startswith("MODEL "), F.col("line").startswith("ENDMDL")
    file = Window.partitionBy("path")
    number = F.trim(F.substring("line", 7, 8)).try_cast("int")
    rows = lines.where(_is_atom(F.col("line")) | marks[0] | marks[1]).select(
        "path", "line_no", "line", F.min(F.when(marks[1], F.col("line_no"))).over(file).alias("_end"), F.min_by(number, F.when(marks[0], F.col("line_no"))).over(file).alias("model")
    )
    return _fields(rows.where(_is_atom(F.col("line")) & (F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))))


def parse_files(files: DataFrame, deal: bool = False) -> DataFrame:
    """The same of files(path, value), each whole in a row: its first model is cut out there, so nothing is exchanged or joined. With `deal`
    the files are dealt by structure beforehand, and what follows by structure needn't exchange atoms, which take more room."""
    if deal:
        files = files.withColumn("structure_id", ids.strip_structure_extension(F.col("path"))).repartition("structure_id")
    begun = F.concat(F.lit("\n"), F.col("value"))
    end, first = F.instr(begun, "\nENDMDL"), F.instr(begun, "\nMODEL ")
    number = F.split(F.substring(F.col("value"), first + 6, F.lit(8)), r"\r?\n")[0]
    model = F.when(first > 0, F.trim(number).try_cast("int")).alias("model")
    cut = F.when(end > 0, F.substring(F.col("value"), F.lit(1), end - 2)).otherwise(F.col("value"))
    lines = files.select("path", *(["structure_id"] if deal else []), model, F.posexplode(F.split(cut, r"\r?\n")).alias("line_no", "line")).where(_is_atom(F.col("line")))
    return _fields(lines.withColumn("line_no", F.col("line_no").cast("long")))


def read_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """files(path, value) of small files, each read whole, as bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("content").cast("string").alias("value"))


def read_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """lines(path, line_no, line) of small files, each read whole."""
    files = read_files(spark, path, glob)
    return files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def read_structures(spark: SparkSession, path: str, extension: str = "ent") -> DataFrame:
    """atoms of every structure file below a folder."""
    return parse_files(read_files(spark, path, f"*.{extension}"))


def read_packed_structures(spark: SparkSession, folder: str) -> DataFrame:
    """The same of structure files that files.write_packed() has packed."""
    return parse_files(read_packed(spark, folder).select("path", F.col("content").cast("string").alias("value")), deal=True)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path and image struct (BGR) of every picture below a folder."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").option("dropInvalid", True).load(path)
    return rows.select(F.col("image.origin").alias("path"), "image")


_IMAGE = {"origin": pa.string(), "height": pa.int32(), "width": pa.int32(), "nChannels": pa.int32(), "mode": pa.int32(), "data": pa.binary()}


def read_packed_images(spark: SparkSession, folder: str) -> DataFrame:
    """The same of PNG files that files.write_packed() has packed. What isn't one is an error."""

    def some(paths: list[str], found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        high, wide, channels, data = zip(*found, strict=True)
        columns = [paths, high, wide, channels, [MODES[n] for n in channels], data]
        image = pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(columns, _IMAGE.values(), strict=True)], list(_IMAGE))
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), image], ["path", "image"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found, held = [], [], 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found.append(decode_png(content.as_py()))
                except Exception as e:
                    raise ValueError(f"{path}: {e}") from e
                paths.append(path)
                held += len(found[-1][3])
                if held >= PACK:
                    yield some(paths, found)
                    paths, found, held = [], [], 0
            if paths:
                yield some(paths, found)

    return read_packed(spark, folder).mapInArrow(run, "path string, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>")
