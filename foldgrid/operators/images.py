"""Pixels, padding and ablation of map images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import single_row

#: Triangle, channel and name of each ablation.
ABLATIONS = (("upper", "r", "vdw_attractive"), ("upper", "g", "vdw_repulsive"), ("upper", "b", "distance"), ("lower", "r", "es_attractive"), ("lower", "g", "es_repulsive"), ("lower", "b", "hydrophobicity"))
# Channel means and deviations by which pictures are standardised.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def pad_array(picture: np.ndarray, size: int = 200, fill: int = 128) -> np.ndarray:
    """Centred on a square of gray, the odd pixel at the end; larger pictures lose what is beyond the upper left square."""
    room = [max(0, size - n) for n in picture.shape[:2]]
    out = np.pad(picture, [*((r // 2, r - r // 2) for r in room), (0, 0)], constant_values=fill)
    return out[:size, :size]


def standardize(picture: np.ndarray) -> np.ndarray:
    """Channels first, scaled to 0..1, less the mean, by the deviation."""
    return ((picture / 255.0 - np.array(MEAN)) / np.array(STD)).transpose(2, 0, 1)


def pad_to_size(images: DataFrame, size: int = 200, fill: int = 128) -> DataFrame:
    """path, height, width, data (BGR bytes as in Spark's image struct) of images(path, image), all of one size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for r in batch.to_pylist():
                picture = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
                data.append(pad_array(picture if r["channels"] == 3 else np.repeat(picture[:, :, :1], 3, axis=2), size, fill).tobytes())
            sides = pa.array([size] * len(data), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sides, sides, pa.array(data, pa.binary())], ["path", "height", "width", "data"])

    flat = images.select("path", F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return flat.mapInArrow(run, "path string, height int, width int, data binary")


#: Pixels that a task hands on at once, about.
PIXELS = 500_000


def unpack_pixels(images: DataFrame) -> DataFrame:
    """pixels(image_id, row, col, r, g, b) of images(image_id, height, width, data) of three channels, blue first."""

    def some(ids: pa.Array, heights: list[int], widths: list[int], data: list[bytes]) -> pa.RecordBatch:
        size = np.array(heights, np.int64) * np.array(widths, np.int64)
        of = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        row, col = np.divmod(at, np.array(widths, np.int64)[of])
        bgr = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 3)
        columns = [pa.array(x.astype(np.int32)) for x in (row, col, bgr[:, 2], bgr[:, 1], bgr[:, 0])]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *columns], ["image_id", "row", "col", "r", "g", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, wide = (batch.column(c).to_pylist() for c in (1, 2))
            first, held = 0, 0
            for k, (h, w) in enumerate(zip(high, wide, strict=True)):
                held += h * w
                if held >= PIXELS or k + 1 == len(high):
                    part = slice(first, k + 1)
                    yield some(batch.column(0)[part], high[part], wide[part], batch.column(3)[part].to_pylist())
                    first, held = k + 1, 0

    flat = images.select("image_id", "height", "width", "data")
    return flat.mapInArrow(run, f"image_id {dict(flat.dtypes)['image_id']}, row int, col int, r int, g int, b int")


def to_pixels(images: DataFrame) -> DataFrame:
    """pixels(image_id, row, col, r, g, b) of images(path, image) with three channels."""
    whole = images.where("image.nChannels = 3").select(F.col("path").alias("image_id"), "image.height", "image.width", "image.data")
    return unpack_pixels(whole)


def channel_means(pixels: DataFrame) -> DataFrame:
    """Mean of each channel over all pixels of all images: one row."""
    return pixels.agg(*[F.avg(c).alias(c) for c in "rgb"])


def image_channel_means(images: DataFrame) -> DataFrame:
    """The same from whole images, whose bytes each task adds up before the one small shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, n = np.zeros(3), 0
            for data, channels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(-1, channels)
                x = x[:, 2::-1] if channels >= 3 else np.repeat(x, 3, axis=1)
                sums, n = sums + x.sum(axis=0), n + len(x)
            yield pa.RecordBatch.from_arrays([pa.array([float(s)]) for s in sums] + [pa.array([n], pa.int64())], ["r", "g", "b", "n"])

    parts = images.select("image.data", "image.nChannels").mapInArrow(run, "r double, g double, b double, n long")
    return parts.agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in "rgb"])


def square_only(pixels: DataFrame) -> DataFrame:
    sides = pixels.groupBy("image_id").agg(F.max("row").alias("_h"), F.max("col").alias("_w")).where("_h = _w").select("image_id")
    return pixels.join(sides, "image_id", "left_semi")


def ablate(pixels: DataFrame, means: DataFrame) -> DataFrame:
    """Six variants of every square image: one triangle of one channel as it is, all else the mean, rounded half to even.

    means: one row (r, g, b), several are an error; the diagonal always gets the mean.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("triangle"), F.lit(c).alias("channel"), F.lit(n).alias("feature")) for t, c, n in ABLATIONS])).alias("k")
    mean = means.select(*[F.least(F.greatest(F.bround(c, 0), F.lit(0)), F.lit(255)).cast("int").alias(f"mean_{c}") for c in "rgb"])
    rows = square_only(pixels).select("*", kinds).crossJoin(F.broadcast(single_row(mean)))
    inside = F.when(F.col("k.triangle") == "upper", F.col("col") > F.col("row")).otherwise(F.col("col") < F.col("row"))
    return rows.select(
        "image_id", F.col("k.feature").alias("feature"), "row", "col", *[F.when(inside & (F.col("k.channel") == c), F.col(c)).otherwise(F.col(f"mean_{c}")).alias(c) for c in "rgb"]
    )


def ablate_images(images: DataFrame, means: DataFrame) -> DataFrame:
    """The same variants of whole images(image_id, height, width, data), as (image_id, feature, height, width, data), blue first."""
    mean = means.select(*[F.least(F.greatest(F.bround(c, 0), F.lit(0)), F.lit(255)).cast("int").alias(f"mean_{c}") for c in "rgb"])
    rows = images.where("height = width").select("image_id", "height", "data").crossJoin(F.broadcast(single_row(mean)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides, ground = batch.column(1).to_pylist(), [batch.column(f"mean_{c}")[0].as_py() for c in "bgr"]
            for triangle, channel, feature in ABLATIONS:
                k, data = "bgr".index(channel), []
                for n, body in zip(sides, batch.column(2), strict=True):
                    out = np.empty((n, n, 3), np.uint8)
                    out[:] = ground
                    inside = np.triu(np.ones((n, n), bool), 1) if triangle == "upper" else np.tril(np.ones((n, n), bool), -1)
                    own = np.frombuffer(body.as_buffer(), np.uint8).reshape(n, n, 3)
                    out[:, :, k][inside] = own[:, :, k][inside]
                    data.append(out.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([feature] * len(data)), batch.column(1), batch.column(1), pa.array(data, pa.binary())], ["image_id", "feature", "height", "width", "data"])

    return rows.mapInArrow(run, f"image_id {dict(images.dtypes)['image_id']}, feature string, height int, width int, data binary")
