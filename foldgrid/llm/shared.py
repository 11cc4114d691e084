"""What the operators share: tables, scratch tables in the shared folder, Arrow batch helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.common import materialize as materialize

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_buckets(spark: SparkSession) -> int:
    """Hash buckets for packed exchanges: they follow the session's shuffle partitions, which follow the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_chunks(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts of a column in chunks of about `limit` bytes: first row, row after the last, UTF-8 bytes, offsets from 0.

    A null counts as an empty text. A text longer than the limit is a chunk of its own.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    _, raw_offsets, raw = col.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 512, dtype=np.uint64) | np.uint64(1)
_BYTE = _RANDOM[:256]
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20) + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive texts, and the index of each text's first word (one more entry at the end).

    Prefix sums of byte values times powers of an odd base give every word's hash without a loop over words.
    """
    n = len(data)
    word = ~_SPACE[data]
    if not n or not word.any():
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    starts = np.flatnonzero(word & (begin[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (begin[1:] | np.concatenate((~word[1:], [True])))) + 1
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of `size` consecutive words, over text borders too: the caller leaves those out."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _RANDOM[256 + k]
    return mix(out)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from f(batch)

    return df.mapInArrow(run, schema)
