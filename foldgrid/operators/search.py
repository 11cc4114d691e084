"""Cosine search over embeddings(item_id, model, vec)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .common import grouped_rank, materialize, single_row

#: Decimals of a score: ties then don't depend on the order of summation.
DECIMALS = 9
_HITS = "query string, target string, score double"
#: Norm below which a vector counts as this long.
SHORTEST = 1e-8
#: Pivots and blocks of a search at most, rows of a block beyond which only the number of blocks makes it grow, scores held at once.
MAX_PIVOTS, MAX_BLOCKS, MAX_ROWS, CELLS = 4096, 262_144, 8192, 2_000_000
#: Rows of a block, as a multiple of the root of all rows.
ROOT = 16
#: Slack of angles and scores in bounds: rounding never hides a hit.
_SLACK, _LEAST = 1e-6, 1e-8


def cosine_query(emb: DataFrame, query: DataFrame) -> DataFrame:
    """(query, target, score) of one query vector against every item; a query of several rows is an error."""
    one = single_row(query.select(F.col("item_id").alias("query"), F.col("vec").alias("qvec")))
    pairs = emb.crossJoin(F.broadcast(one))
    return pairs.select("query", F.col("item_id").alias("target"), F.round(vectors.cosine("qvec", "vec"), DECIMALS).alias("score"))


def _best(scores: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each row, ties to the first columns; in no order."""
    if k is None or k >= scores.shape[1]:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    last = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, equal = scores > last, scores == last
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), SHORTEST)


def _product(k: int | None):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item_id")
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "target": [], "score": []}).astype({"query": str, "target": str, "score": float})
        a, b = (_unit(np.stack(x["vec"].to_numpy()).astype(np.float64)) for x in (left, right))
        scores = np.round(a @ b.T, DECIMALS)
        row, col = _best(scores, k)
        return pd.DataFrame({"query": left["item_id"].to_numpy()[row], "target": right["item_id"].to_numpy()[col], "score": scores[row, col]})

    return run


def cosine_blocks(emb: DataFrame, k: int | None = None, blocks: int | None = None, rows_a_block: int = 4096, queries: DataFrame | None = None) -> DataFrame:
    """(query, target, score): for each query its k best targets of every block (all targets when k is None), itself included.

    Items are hashed to blocks and each pair of blocks is one matrix product in one task; no more than k rows a query
    leave it. queries: the items to search for, all of them unless given.
    """
    if blocks is None:
        blocks = max(1, -(-emb.count() // rows_a_block))
    item = F.col("item_id").cast("string")
    block = F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = emb if queries is None else queries
    left = asked.select(item.alias("item_id"), "vec", F.lit(0).alias("side"), block.alias("i"), others.alias("j"))
    right = emb.select(item.alias("item_id"), "vec", F.lit(1).alias("side"), block.alias("j"), others.alias("i"))
    return left.unionByName(right).groupBy("i", "j").applyInPandas(_product(k), _HITS)


def cosine_all_pairs(emb: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every item against every item, itself included."""
    return cosine_blocks(emb, None, blocks)


def rank_hits(scores: DataFrame) -> DataFrame:
    """Rank of each target by score, best first, ties by name."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("target").asc())
    return scores.withColumn("rank", F.row_number().over(order))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return rank_hits(scores).where(F.col("rank") <= k)


def search_one(emb: DataFrame, query: DataFrame, k: int = 5) -> DataFrame:
    """The k best targets of one query, the query itself left out."""
    scores = cosine_query(emb, query).where("target != query")
    best = scores.orderBy(F.col("score").desc(), F.col("target").asc()).limit(k)
    return rank_hits(best)


@dataclass
class Filed:
    """Items filed by their nearest pivot, in blocks that are rings about it.

    rows(block, item_id, v): all items, written once; v: the unit vector's doubles. blocks: one row (block, pivot, least and greatest
    angle) each, at most about MAX_BLOCKS; pivot -1 holds what is shorter than SHORTEST, which no angle bounds.
    """

    rows: DataFrame
    pivots: np.ndarray
    blocks: np.ndarray


def _arrow(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _raw(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def file_items(emb: DataFrame, rows_a_block: int = 256) -> Filed:
    """Items with a vector, each with its nearest pivot; pivots are items in the order of a hash. A pivot that a third of the items
    stand at fills as many blocks as they need: blocks are ranks by angle, then item, which many tasks count together. Whatever the
    partitions, there are as many blocks as pivots and full blocks together, at most."""
    items = emb.where(F.col("vec").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("vec").cast("array<double>").alias("vec"))
    n = items.count()
    # a vector is sent to the blocks it asks for, so blocks grow with the root of the rows, as long as they are small for a task
    size = max(rows_a_block, min(MAX_ROWS, int(ROOT * n**0.5)), -(-n // MAX_BLOCKS))
    some = items.orderBy(F.xxhash64("item_id"), "item_id").limit(min(MAX_PIVOTS, -(-n // size))).select("vec").collect()
    pivots = np.array([r.vec for r in some], np.float64) if some else np.zeros((0, 1))
    pivots = _unit(pivots[np.sqrt((pivots * pivots).sum(axis=1)) >= SHORTEST])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _arrow(batch.column(1))
            unit, short = _unit(x), np.sqrt((x * x).sum(axis=1)) < SHORTEST
            angle = _angles(unit, pivots) if len(pivots) else np.zeros((len(x), 1))
            file = np.where(short | (not len(pivots)), -1, angle.argmin(axis=1)).astype(np.int32)
            angle = np.where(file < 0, 0.0, angle.min(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _raw(unit), pa.array(file), pa.array(angle)], ["item_id", "v", "pivot", "angle"])

    filed = items.mapInArrow(nearest, "item_id string, v binary, pivot int, angle double")
    ranked = grouped_rank(filed, ["pivot"], ["angle", "item_id"])
    rows = materialize(ranked.select((F.col("pivot") * F.lit(1 << 32) + F.floor((F.col("_rank") - 1) / size)).alias("block"), "item_id", "v", "pivot", "angle"))
    ends = rows.groupBy("block", "pivot").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("block").collect()
    blocks = np.array([tuple(r) for r in ends], [("block", np.int64), ("pivot", np.int64), ("lo", float), ("hi", float), ("n", np.int64)])
    return Filed(rows.select("block", "item_id", "v"), pivots, blocks)


def _wanted(unit: np.ndarray, floor: np.ndarray, pivots: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks that may hold a score of at least `floor`, with the rows that ask for them.

    A target at angle t from a pivot is at least |a - t| away from a query at angle a from it.
    """
    angle = _angles(unit, pivots) if len(pivots) else None
    for b in blocks:
        if b["pivot"] < 0:
            yield int(b["block"]), np.arange(len(unit))
            continue
        a = angle[:, b["pivot"]]
        least = np.maximum(np.maximum(a - b["hi"], b["lo"] - a) - _SLACK, 0)
        rows = np.flatnonzero(np.cos(least) + _LEAST >= floor)
        if len(rows):
            yield int(b["block"]), rows


def _by_block(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[pa.Array]]]:
    """Rows of sorted batches by their first column, one block at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        block = batch.column(0).to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else [0]
        for lo, hi in zip(ends, ends[1:], strict=False):
            if held and block[lo] != now:
                yield now, [pa.concat_arrays([h.column(c) for h in held]) for c in range(columns)]
                held = []
            now = int(block[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, [pa.concat_arrays([h.column(c) for h in held]) for c in range(columns)]


def _vectors(raw: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), -1)


def _slices(n: int, width: int) -> Iterator[tuple[int, int]]:
    """Ranges of n rows that hold CELLS values at most, of `width` each (one row at least)."""
    step = max(1, CELLS // max(1, width))
    for first in range(0, n, step):
        yield first, min(n, first + step)


def _by_blocks(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block", *columns)


def _asked(pivots: np.ndarray, blocks: np.ndarray, k: int, count: bool = False):  # noqa: ANN202
    """Each block against itself gives its items' k-th best scores so far; the rows that each item asks of other blocks, and its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, (_, ids, raw) in _by_block(batches, 3):
            unit = _vectors(raw)
            n = len(unit)
            floor = np.full(n, -2.0)
            for lo, hi in _slices(n, n) if n >= k else ():
                floor[lo:hi] = np.partition(np.round(unit[lo:hi] @ unit.T, DECIMALS), n - k, axis=1)[:, n - k]
            for block, rows in _wanted(unit, floor, pivots, blocks):
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([block]), pa.array([len(rows)])], ["own", "block", "asked"])
                    continue
                at = pa.array(rows)
                columns = [pa.array(np.full(len(rows), block)), pa.array(np.ones(len(rows), np.int32)), ids.take(at), raw.take(at), pa.array(floor[rows])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "side", "item_id", "v", "floor"])

    return run


def _answers(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, targets, held = None, None, None, []
        for batch in batches:
            key = [batch.column(c).to_numpy() for c in (0, 1, 2)]
            new = np.flatnonzero((np.diff(key[0], prepend=-1) != 0) | (np.diff(key[1], prepend=-1) != 0) | (np.diff(key[2], prepend=-1) != 0))
            for lo, hi in zip(new.tolist(), [*new.tolist()[1:], len(key[0])], strict=True):
                part, at = batch.slice(lo, hi - lo), (int(key[0][lo]), int(key[1][lo]))
                if at != now:
                    now, names, targets, held = at, None, None, []
                if key[2][lo] == 0:
                    held.append((part.column(3), _vectors(part.column(4))))
                    continue
                if targets is None:
                    names = np.array(pa.concat_arrays([h[0] for h in held]).to_pylist(), object)
                    order = np.argsort(names.astype(str), kind="stable")
                    names, targets = names[order], np.concatenate([h[1] for h in held])[order]
                asked, floor = _vectors(part.column(4)), part.column(5).to_numpy()
                for a, b in _slices(len(asked), len(targets)):
                    scores = np.round(asked[a:b] @ targets.T, DECIMALS)
                    row, col = _best(scores, k)
                    good = scores[row, col] >= floor[a:b][row]
                    row, col = row[good], col[good]
                    yield pa.RecordBatch.from_arrays([part.column(3).take(pa.array(row + a)), pa.array(names[col], pa.string()), pa.array(scores[row, col])], ["query", "target", "score"])

    return run


def pruned_hits(emb: DataFrame, k: int, rows_a_block: int = 256) -> DataFrame:
    """(query, target, score) that hold the k best targets of every item, itself included: the same rows by top_k() as of cosine_blocks().

    Items are filed by their nearest pivot, in blocks. A first round within each block gives its items a score that their k-th best
    target reaches at least; in the second, an item goes only to blocks that the triangle inequality of angles doesn't rule out
    below it. Queries of one block come to it in groups by their own block, so that a block that all ask for is many tasks' work.
    Items without a vector are left out. Runs jobs for the count, the pivots and the blocks' angles.
    """
    filed = file_items(emb, rows_a_block)
    crowd = max(1, len(filed.blocks) // 64)
    salt = F.pmod(F.xxhash64("item_id"), F.lit(crowd)).cast("int").alias("salt")
    asked = _by_blocks(filed.rows, "item_id").mapInArrow(_asked(filed.pivots, filed.blocks, k), "block long, side int, item_id string, v binary, floor double")
    asked = asked.select("block", salt, "side", "item_id", "v", "floor")
    copies = F.explode(F.sequence(F.lit(0), F.lit(crowd - 1))).alias("salt")
    targets = filed.rows.select("block", copies, F.lit(0).alias("side"), "item_id", "v", F.lit(0.0).alias("floor"))
    both = targets.unionByName(asked).repartition("block", "salt").sortWithinPartitions("block", "salt", "side")
    return both.mapInArrow(_answers(k), _HITS)


def pruning_report(emb: DataFrame, k: int, rows_a_block: int = 256) -> DataFrame:
    """One row: blocks, pairs of blocks, pairs compared, and the vectors sent to blocks (asked) of the vectors times blocks (possible)."""
    filed = file_items(emb, rows_a_block)
    n, items = len(filed.blocks), int(filed.blocks["n"].sum())
    pairs = _by_blocks(filed.rows, "item_id").mapInArrow(_asked(filed.pivots, filed.blocks, k, count=True), "own long, block long, asked long")
    counts = pairs.agg(F.count(F.lit(1)).alias("compared"), F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"))
    return counts.select(F.lit(n).alias("blocks"), F.lit(n * n).alias("pairs"), "compared", "asked", F.lit(items * n).alias("possible"))


def search_all(emb: DataFrame, k: int, blocks: int | None = None, one_block: int = 4096) -> DataFrame:
    """The k best targets of every item, itself included. Up to `one_block` items are one product; more are searched by pruned
    blocks, unless a number of blocks is given."""
    if blocks is None and emb.limit(one_block + 1).count() > one_block:
        return top_k(pruned_hits(emb, k), k)
    return top_k(cosine_blocks(emb, k, blocks or 1), k)


#: Numbers of padded pictures that a task holds at once, about.
IMAGE_FLOATS = 4_000_000


def embed(images: DataFrame, embedder, model: str, size: int = 200) -> DataFrame:  # noqa: ANN001
    """embeddings of images(path, image struct): padded, scaled, standardised, then `embedder` on batches.

    embedder: a function of a float array (n, 3, size, size) that returns (n, d); it is sent to the workers once each.
    """
    from .images import pad_array, standardize

    few = max(1, IMAGE_FLOATS // (3 * size * size))

    def run(batches):  # noqa: ANN001, ANN202
        for rows in (batch.slice(k, few).to_pylist() for batch in batches for k in range(0, batch.num_rows, few)):
            pictures = [np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n_channels"]) for r in rows]
            x = np.stack([standardize(pad_array(p[:, :, ::-1] if p.shape[2] == 3 else np.repeat(p[:, :, :1], 3, axis=2), size)) for p in pictures])
            out = np.asarray(embedder(x), np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["item_id"] for r in rows]), pa.array([model] * len(rows)), pa.array(list(out), pa.list_(pa.float32()))], ["item_id", "model", "vec"]
            )

    flat = images.select(
        F.col("path").alias("item_id"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data")
    )
    return flat.mapInArrow(run, "item_id string, model string, vec array<float>")
