"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry, in whole numbers throughout.

The parts of all vectors are sorted along a Hilbert curve and cut into flat blocks of at most `BLOCK` rows, which are written
once. A block holds its rows, the ends of the box around them and their sum. In each round, the least and greatest distance of
every entry from a block's box leave a shortlist: an entry whose least distance exceeds another's greatest is nearest to no row.
A block with one entry on its list goes to it with its sum, without looking at rows; the others compare their rows with the
list in one small product. Counts and sums by entry, at most parts x entries rows of each task, make the next codebooks.

Distances are exact: products run in double precision where all of their sums stay below 2**53, else in Python's integers.

Rows whose vector is null or empty, or holds null or non-finite components, are dropped. So are vectors of another length than
the one with the smallest id. Where the length isn't a multiple of the parts, zeros are appended. Null ids count as the
greatest; ids that occur twice are rows of their own, in the order of their vectors where the starting codebook needs one.
Fewer rows than entries make as many entries as rows. Components beyond a long (after scaling) are cut to its ends, as are
errors. An empty table gives an empty result. Other columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Rows of a block.
BLOCK = 256
_LONG = (1 << 63) - 1


def hilbert_keys(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of each row along a Hilbert curve through the box from low to high; rows outside of it count as on its faces.

    The curve takes at most 21 leading components, with 63 bits among them.
    """
    n = min(x.shape[1], 21)
    bits = min(16, 63 // n)
    width = np.maximum((high - low)[:n].astype(np.float64), 1.0)
    grid = np.clip((x[:, :n].astype(np.float64) - low[:n].astype(np.float64)) / width, 0, 1) * ((1 << bits) - 1)
    at = list(np.rint(grid).astype(np.int64).T)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns and mirrors of the larger cells
        for i in range(n):
            swap = np.where(at[i] & q, 0, (at[0] ^ at[i]) & (q - 1))
            at[0] = np.where(at[i] & q, at[0] ^ (q - 1), at[0] ^ swap)
            if i:
                at[i] = at[i] ^ swap
        q >>= 1
    for i in range(1, n):
        at[i] = at[i] ^ at[i - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(at[-1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((at[i] ^ turn) >> bit) & 1)
    return key


def _exact(*arrays: np.ndarray) -> type:
    """The fastest type in which squared distances of rows of these arrays are exact."""
    most = max((max(abs(int(a.min())), abs(int(a.max()))) for a in arrays if a.size), default=0)
    return np.float64 if 4 * most * most * max(a.shape[-1] for a in arrays) < 1 << 52 else object


def shortlist(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries (places, in order) that may be nearest to a row of the box from low to high."""
    kind = _exact(low[None], high[None], entries)
    e, lo, hi = entries.astype(kind), low.astype(kind), high.astype(kind)
    near = np.maximum(np.maximum(lo - e, e - hi), 0)
    far = np.maximum(np.abs(e - lo), np.abs(e - hi))
    near, far = (near * near).sum(axis=1), (far * far).sum(axis=1)
    return np.flatnonzero(near <= far.min())


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row's nearest entry (ties to the first) and the squared distance."""
    kind = _exact(rows, entries)
    r, e = rows.astype(kind), entries.astype(kind)
    d = (r * r).sum(axis=1)[:, None] - 2 * (r @ e.T) + (e * e).sum(axis=1)[None, :]
    at = np.argmin(d, axis=1)
    best = d[np.arange(len(rows)), at]
    return at, np.array([min(int(x), _LONG) for x in best], np.int64) if kind is object else best.astype(np.int64)


def kept_vectors(emb: DataFrame, vec: str, keep: dict[str, str], scale: int) -> DataFrame:
    """rid, the columns of `keep` and x (array<long>, components times `scale`, cut to whole numbers) of rows with a sound vector."""
    sound = F.forall(vec, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = F.transform(vec, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = emb.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & sound)
    return materialize(rows.select(F.monotonically_increasing_id().alias("rid"), *[F.col(c).alias(k) for k, c in keep.items()], x.alias("x")))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; zeros stand for what they lack of `width`."""
    flat = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
    return np.pad(flat, ((0, 0), (0, width - flat.shape[1])))


def _sort_keys(parts: int, width: int, low: np.ndarray, high: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), parts * width)
            for p in range(parts):
                own = np.ascontiguousarray(x[:, p * width : (p + 1) * width], np.int64)
                key = hilbert_keys(own, low[p], high[p])
                raw = pa.array([r.tobytes() for r in own], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(own), p, np.int32)), pa.array(key), raw], ["rid", "part", "key", "v"])

    return run


_BLOCK = "part int, n int, ids binary, rows binary, low binary, high binary, total binary"


def _blocks(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(-1, width)
            cut = np.flatnonzero(np.diff(part)) + 1
            ends = [0, *cut.tolist(), len(part)]
            spans = [(a, min(a + BLOCK, hi)) for lo, hi in zip(ends, ends[1:]) for a in range(lo, hi, BLOCK)]
            make = lambda f: pa.array([f(a, b).tobytes() for a, b in spans], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(part[a]) for a, _ in spans], pa.int32()),
                    pa.array([b - a for a, b in spans], pa.int32()),
                    make(lambda a, b: rid[a:b]),  # noqa: B023
                    make(lambda a, b: rows[a:b]),  # noqa: B023
                    make(lambda a, b: rows[a:b].min(axis=0)),  # noqa: B023
                    make(lambda a, b: rows[a:b].max(axis=0)),  # noqa: B023
                    make(lambda a, b: rows[a:b].sum(axis=0)),  # noqa: B023
                ],
                [c.split()[0] for c in _BLOCK.split(", ")],
            )

    return run


def hilbert_blocks(vectors: DataFrame, parts: int, width: int, start: np.ndarray) -> DataFrame:
    """Blocks of all parts of vectors(rid, x), in the order of the curve through the box of the starting entries.

    Rows are dealt out by ranges of part, curve and row id, so a vector that makes up a third of the table fills many ranges.
    """
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = vectors.select("rid", "x").mapInArrow(_sort_keys(parts, width, start.min(axis=1), start.max(axis=1)), "rid long, part int, key long, v binary")
    line = ["part", "key", "rid"]
    dealt = keyed.repartitionByRange(spread, *line).sortWithinPartitions(*line).select("rid", "part", "v")
    return materialize(dealt.mapInArrow(_blocks(width), _BLOCK))


def _each(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """part, n, ids, rows, ends of the box and sum of every block."""
    for part, n, ids, rows, low, high, total in zip(*[c.to_pylist() for c in batch.columns], strict=True):
        ints = lambda b: np.frombuffer(b, np.int64)
        yield part, n, ints(ids), ints(rows).reshape(n, width), (ints(low), ints(high)), ints(total)


def _sums(books: np.ndarray) -> Callable:
    """Rows and sums by part and entry of a task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = books.shape
        count, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for part, n, _, rows, box, total in _each(batch, width):
                listed = shortlist(*box, books[part])
                if len(listed) == 1:
                    count[part, listed[0]] += n
                    sums[part, listed[0]] += total
                    continue
                at, _ = nearest(rows, books[part][listed])
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                own = listed[at[order][first]]
                count[part, own] += np.diff(first, append=n)
                sums[part, own] += np.add.reduceat(rows[order], first, axis=0)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "s"],
        )

    return run


def _assign(books: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books.shape[2]
        for batch in batches:
            for part, n, ids, rows, box, _ in _each(batch, width):
                listed = shortlist(*box, books[part])
                at, d = nearest(rows, books[part][listed])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(n, part, np.int32)), pa.array(listed[at].astype(np.int32)), pa.array(d)], ["rid", "part", "entry", "d"])

    return run


def next_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: means of the entries' rows, cut down to whole numbers; unused entries stay.

    At most parts x entries rows come to the driver.
    """
    width = books.shape[2]
    found = blocks.mapInArrow(_sums(books), "part int, entry int, n long, s array<long>").groupBy("part", "entry")
    out = books.copy()
    for r in found.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(k))) for k in range(width)]).alias("s")).collect():
        out[r.part, r.entry] = [x // r.n for x in r.s]
    return out


def compress(emb: DataFrame, vec: str = "embedding", id_col: str = "vec_id", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes array<int>, error long) of every row with a sound vector, and the codebooks (parts, entries, width).

    Codebooks start as the parts of the vectors of the smallest ids. Runs a few jobs a round.
    """
    vectors = kept_vectors(emb, vec, {"id": id_col, "label": label}, scale)
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "x").select("x")
    one = first.head(1)
    if not one:
        return vectors.select("id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    size = len(one[0].x)
    width = -(-size // parts)
    vectors = vectors.where(F.size("x") == size)
    start = np.zeros((entries, parts * width), np.int64)
    rows = first.where(F.size("x") == size).limit(entries).collect()
    start[: len(rows), :size] = [r.x for r in rows]
    books = np.ascontiguousarray(start[: len(rows)].reshape(len(rows), parts, width).transpose(1, 0, 2))
    blocks = hilbert_blocks(vectors, parts, width, books)
    for _ in range(rounds):
        books = next_books(blocks, books)
    coded = blocks.mapInArrow(_assign(books), "rid long, part int, entry int, d long")
    none: list[Column] = [F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("entry"), F.lit(None).cast("long").alias("d")]
    own = vectors.select("rid", "id", "label", *none)
    both = own.unionByName(coded, allowMissingColumns=True)
    code = F.array(*[F.max(F.when(F.col("part") == p, F.col("entry"))) for p in range(parts)])
    error = F.least(F.sum(F.col("d").cast("decimal(38,0)")), F.lit(_LONG)).cast("long")
    rows = both.groupBy("rid").agg(F.max("id").alias("id"), F.max("label").alias("label"), code.alias("codes"), error.alias("error"))
    return rows.drop("rid"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Coded rows with the errors of their label summed (label_error); null labels count as one.

    Summed in each task before the shuffle, and joined from written tables, so that a label of a third of the rows can be split.
    """
    rows = materialize(coded)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG)).cast("long")
    sums = materialize(rows.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same in SQL, one pair of tables a round."""
    near = """{to} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d
  FROM (SELECT v.rid, v.part, b.entry, CAST(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM v JOIN {book} b ON v.part = b.part) GROUP BY 1, 2)"""
    book = """{to} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
    SELECT part, entry, list(s ORDER BY i) AS x FROM (
      SELECT a.part, a.entry, i, CAST(floor(sum(v.x[i]) / count(*)) AS BIGINT) AS s
      FROM {near} a JOIN v ON v.rid = a.rid AND v.part = a.part, (SELECT unnest(range(1, 17)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2) m
  ON m.part = b.part AND m.entry = b.entry)"""
    steps = []
    for k in range(rounds):
        steps += [near.format(to=f"n{k}", book=f"b{k}"), book.format(to=f"b{k + 1}", book=f"b{k}", near=f"n{k}")]
    steps.append(near.format(to="last", book=f"b{rounds}"))
    return f"""WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false)))),
v AS MATERIALIZED (SELECT rid, p AS part, x[p * 16 + 1 : p * 16 + 16] AS x FROM e, (SELECT unnest(range(0, {parts})) AS p)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM v WHERE rid <= {entries}),
{", ".join(steps)},
c AS (SELECT rid, string_agg(lower(format('{{:02x}}', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY 1)
SELECT e.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN e ON e.rid = c.rid"""


ORACLE = _oracle()
