"""k-means over embeddings, in whole numbers: every run gives the same clusters, whatever the partitions.

Components are taken as floor(scale * x), so distances and sums are exact and don't depend on the order of adding. Centres start from
rounds of draws by distance: the first is the item of the least seeded hash; each further round draws twice the wanted number of items at
once, an item's chance growing with its squared distance to the centres drawn so far (the least -ln(u) / distance, u from the seeded
hash). Drawn centres weigh the items nearest to them, and are thinned out by the greatest weight times distance. Each step of Lloyd
then sends the sums of its clusters from every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, seeded

#: Numbers that the driver and each task hold as centres.
MAX_CENTRE_NUMBERS = 16_000_000

#: Distances computed at once in a task.
SLICE = 1 << 21


def _rows(column: pa.Array, size: int) -> np.ndarray:
    """A list column as rows of whole numbers."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(lists) and not (np.diff(lists.offsets.to_numpy()) == size).all():
        raise ValueError(f"vectors of other lengths than {size}")
    return lists.flatten().to_numpy().reshape(-1, size).astype("float64")


def _nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and squared distance of each row's nearest centre; of equal distances the first centre's. Exact below 2 ** 53."""
    place, least = np.empty(len(v), "int64"), np.empty(len(v), "int64")
    norms, step = (centres * centres).sum(axis=1), max(1, SLICE // len(centres))
    for a in range(0, len(v), step):
        part = v[a : a + step]
        d = (part * part).sum(axis=1)[:, None] - 2 * (part @ centres.T) + norms
        place[a : a + step] = d.argmin(axis=1)
        least[a : a + step] = d.min(axis=1)
    return place, least


def _measured(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """item_id, v, place and d2 of the nearest centre."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, d2 = _nearest(_rows(b.column("v"), centres.shape[1]), centres)
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("v"), pa.array(place), pa.array(d2)], ["item_id", "v", "place", "d2"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(measure, f"item_id {kind}, v array<long>, place long, d2 long")


def _moved(items: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centres after a step of Lloyd: the floor of their items' mean. A centre without items stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centres.shape, "int64"), np.zeros(len(centres), "int64")
        for b in batches:
            v = _rows(b.column("v"), centres.shape[1])
            place, _ = _nearest(v, centres)
            np.add.at(total, place, v.astype("int64"))
            n += np.bincount(place, minlength=len(centres))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["place", "n", "s"])

    parts = items.mapInArrow(sums, "place long, n long, s array<long>")
    each = parts.select("place", "n", F.posexplode("s").alias("pos", "x"))
    rows = each.groupBy("place", "pos").agg(F.sum("x").alias("s"), F.sum("n").alias("n")).collect()
    moved = centres.copy()
    for r in rows:
        moved[r.place, r.pos] = r.s // r.n
    return moved


def _seeds(items: DataFrame, k: int, seed: int, rounds: int) -> np.ndarray:
    first = items.orderBy(seeded(F.concat_ws("|", F.col("item_id").cast("string"), F.lit(0)), seed), "item_id").select("v").head()
    centres = np.array([first.v], "float64")
    for r in range(1, rounds + 1):
        draw = F.conv(F.substring(seeded(F.concat_ws("|", F.col("item_id").cast("string"), F.lit(r)), seed), 1, 13), 16, 10).cast("double")
        key = -F.log((draw + 1) / F.lit(float(1 << 52))) / F.col("d2")
        more = _measured(items, centres).where("d2 > 0").orderBy(key, "item_id").limit(2 * k).select("v").collect()
        centres = np.vstack([centres, np.array([x.v for x in more], "float64").reshape(-1, centres.shape[1])])
    weights = {x.place: x.n for x in _measured(items, centres).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = [weights.get(n, 0) for n in range(len(centres))]
    kept = [max(range(len(centres)), key=lambda n: (weight[n], -n))]
    least = ((centres - centres[kept[0]]) ** 2).sum(axis=1)
    while len(kept) < k:
        worth = [w * int(d) for w, d in zip(weight, least, strict=True)]
        best = max(range(len(centres)), key=lambda n: (worth[n], -n))
        if not worth[best]:
            break
        kept.append(best)
        least = np.minimum(least, ((centres - centres[best]) ** 2).sum(axis=1))
    return centres[kept]


def cluster(emb: DataFrame, k: int, seed: int = 42, steps: int = 20, scale: int = 1024, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(item_id, cluster) and (cluster, centre) of k-means over embeddings(item_id, vec), centres in the vectors' measure.

    Lloyd's steps end after `steps`, or when no centre moves. Ties go to the lower cluster. A cluster that loses its items keeps its
    centre; fewer than k different vectors give fewer clusters. Items whose vector is null or empty or holds null or non-finite
    components are left out; repeated rows count as often as they occur. Vectors of several lengths, components too large for exact
    distances, and more centres than MAX_CENTRE_NUMBERS allows are errors. No items give no clusters.
    """
    whole = F.transform("vec", lambda x: F.floor(x.cast("double") * scale))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    items = materialize(emb.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & sound).select("item_id", whole.alias("v")))
    facts = items.agg(F.max(F.size("v")).alias("size"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    if facts.size is None:
        return items.select("item_id", F.lit(0).alias("cluster")), emb.sparkSession.createDataFrame([], "cluster int, centre array<double>")
    if 4 * facts.size * facts.top**2 >= 1 << 53:
        raise ValueError(f"components up to {facts.top / scale} are too large for scale {scale}")
    if (2 * rounds * k + 1) * facts.size > MAX_CENTRE_NUMBERS:
        raise ValueError(f"{k} centres of {facts.size} components are more than {MAX_CENTRE_NUMBERS} numbers")
    centres = _seeds(items, k, seed, rounds)
    for _ in range(steps):
        moved = _moved(items, centres)
        if (moved == centres).all():
            break
        centres = moved
    assigned = _measured(items, centres).select("item_id", F.col("place").cast("int").alias("cluster"))
    rows = [(n, [float(x) / scale for x in c]) for n, c in enumerate(centres)]
    return assigned, emb.sparkSession.createDataFrame(rows, "cluster int, centre array<double>")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def first_of_clusters(assigned: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("cluster").orderBy("item_id")
    return assigned.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
