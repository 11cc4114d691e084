"""Residues, residue pairs and their maps, as long tables keyed by structure and position."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chemistry as C
from ..functions import constants as K
from .common import materialize

RESIDUE = ("structure_id", "chain", "res_seq", "icode")
#: The two sets of channels of the second map version: the upper triangle's and the rotated one's.
UPPER, LOWER = ("vdw_att", "vdw_rep", "dist"), ("es_att", "es_rep", "hydro")


def best_altloc(atoms: DataFrame) -> DataFrame:
    """One place for each atom: without alternate location, else the one of highest occupancy, else the first. Atoms are dealt by
    structure, so what follows by structure or within it needs no further exchange."""
    choice = F.struct((F.coalesce(F.trim("altloc"), F.lit("")) == "").cast("int"), F.coalesce("occupancy", F.lit(0.0)), -F.col("line_no"))
    within = (*RESIDUE[1:], "atom_name")
    line = Window.partitionBy(RESIDUE[0]).orderBy(*within, choice.desc())
    before = F.lag(F.struct(*within)).over(line)
    return atoms.withColumn("_b", before.eqNullSafe(F.struct(*within))).where("NOT _b").drop("_b")


def residue_index(atoms: DataFrame) -> DataFrame:
    """residues(structure_id, res_idx, aa, x, y, z): 0-based place of every residue with a known letter, in chain order,
    at its alpha carbon (null coordinates when it has none)."""
    ca = lambda c: F.max(F.when(F.trim("atom_name") == "CA", F.col(c))).alias(c)
    rows = best_altloc(atoms).withColumn("aa", C.to_one_letter(F.col("res_name"))).where("aa IS NOT NULL")
    rows = rows.groupBy(*RESIDUE).agg(F.min_by("aa", "line_no").alias("aa"), F.min("line_no").alias("line_no"), ca("x"), ca("y"), ca("z"))
    order = Window.partitionBy("structure_id").orderBy("line_no")
    return rows.select("structure_id", (F.row_number().over(order) - 1).alias("res_idx"), "aa", "x", "y", "z")


def sequence(residues: DataFrame) -> DataFrame:
    """structure_id, sequence, n."""
    letters = F.array_sort(F.collect_list(F.struct("res_idx", "aa")))
    rows = residues.groupBy("structure_id").agg(letters.alias("r"))
    return rows.select("structure_id", F.array_join(F.transform("r", lambda x: x["aa"]), "").alias("sequence"), F.size("r").alias("n"))


def peptide_sequence(atoms: DataFrame, max_cn: float = 1.8) -> DataFrame:
    """structure_id, sequence of the residues in continuous backbone runs: a run breaks where the carbon of one residue
    and the nitrogen of the next are further apart than `max_cn` Angstrom or missing; single residues are left out."""
    place = F.struct("x", "y", "z")
    at = lambda name: F.max(F.when(F.trim("atom_name") == name, place))
    rows = best_altloc(atoms).withColumn("aa", C.to_one_letter(F.col("res_name"))).where("aa IS NOT NULL")
    rows = rows.groupBy(*RESIDUE).agg(F.min_by("aa", "line_no").alias("aa"), F.min("line_no").alias("line_no"), at("C").alias("c"), at("N").alias("n"))
    order = Window.partitionBy("structure_id", "chain").orderBy("line_no")
    gap = C.distance(F.lag("c").over(order), F.col("n"))
    rows = rows.withColumn("new", F.when(gap <= max_cn, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    rows = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("structure_id", "chain", "run"))).where("size > 1")
    return rows.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "aa"))).alias("r")).select(
        "structure_id", F.array_join(F.transform("r", lambda x: x["aa"]), "").alias("sequence")
    )


#: Residue pairs that one stretch of a chain makes at most, about.
PAIRS = 2_000_000


_SPOT = ("res_idx", "aa", "x", "y", "z")


def _chain_starts(residues: DataFrame) -> DataFrame:
    """(structure_id, n, k, a, and an array for each column of a residue) for all places k of each structure but the last.

    The arrays are the structure's residues in order, a the one at place k. A chain is one row; its places are taken in as many
    stretches as their pairs fill, dealt out as tasks of their own, and nothing is joined. Runs a job for the length of the
    longest chain.
    """
    chains = residues.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct(*_SPOT))).alias("chain"), F.count(F.lit(1)).alias("n")).where("n > 1")
    part_of = lambda c: F.transform("chain", lambda r: r[c]).alias(c)
    longest = residues.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest * longest <= 2 * PAIRS:  # dealt by structure alone, what follows by structure needs no exchange of pairs
        dealt = chains.withColumns({"parts": F.lit(1), "part": F.lit(0)})
    else:
        parts = F.ceil(F.col("n") * F.col("n") / (2 * PAIRS)).cast("int")
        stretches = chains.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        # by number: Spark would put what is small before it grows into a few tasks
        dealt = stretches.repartition(int(residues.sparkSession.conf.get("spark.sql.shuffle.partitions")), "structure_id", "part")
    dealt = dealt.select("structure_id", F.col("n").cast("int").alias("n"), "parts", "part", *[part_of(c) for c in _SPOT])
    # every parts-th residue, so stretches have about as many pairs each
    starts = F.explode(F.sequence(F.col("part"), F.greatest(F.col("n") - 1, F.col("part")), F.col("parts"))).alias("k")
    begun = dealt.select("structure_id", "n", *_SPOT, starts).where(F.col("k") < F.col("n") - 1)
    return begun.select("*", F.struct(*[F.get(c, F.col("k")).alias(c) for c in _SPOT]).alias("a"))


def _chain_pairs(residues: DataFrame) -> DataFrame:
    """The rows of _chain_starts() with j, for all pairs of places k < j."""
    return _chain_starts(residues).select("*", F.explode(F.sequence(F.col("k") + 1, F.col("n") - 1)).alias("j"))


def _at(place: Column) -> Column:
    """The residue at a place of a chain."""
    return F.struct(*[F.get(c, place).alias(c) for c in _SPOT])


def residue_pairs(residues: DataFrame, scale: float = 1.0) -> DataFrame:
    """(structure_id, i, j, aa_i, aa_j, dist) for all i < j of each structure. One shuffle by structure, of residues; a chain must fit
    a row, its pairs needn't fit a task. Residues that share a number make no pair."""
    a, b = F.col("a"), _at(F.col("j"))
    pairs = _chain_pairs(residues).select("structure_id", a["res_idx"].alias("i"), b["res_idx"].alias("j"), a["aa"].alias("aa_i"), b["aa"].alias("aa_j"), C.distance(a, b, scale).alias("dist"))
    return pairs.where("i < j")


def with_hydrophobicity(pairs: DataFrame, cutoff: float = 10.0) -> DataFrame:
    return pairs.withColumn("hydro", C.hydrophobicity_delta(F.col("aa_i"), F.col("aa_j"), F.col("dist"), cutoff))


def contact_maps_v1(residues: DataFrame, cutoff: float = 15.0, turned: bool = False) -> DataFrame:
    """Pairs (structure_id, i, j, aa_i, aa_j, dist) with hydro, charge and polarity of the older version, where residues touch when their
    own distance or the one at the rotated place is below the cutoff, and a missing distance counts as 0.

    residues: of residue_index(), numbered from 0 without gaps. The rotated place of (i, j) in a chain of n is (n - 1 - j, n - 1 - i): its
    residues are read from the chain by position. `turned` keeps the distance there as a column of that name.
    """
    far = lambda c: _at(F.col("n") - 1 - F.col(c))
    a, b = F.col("a"), _at(F.col("j"))
    known = lambda x, y: F.coalesce(C.distance(x, y), F.lit(0.0))
    out = _chain_pairs(residues).select("structure_id", F.col("k").alias("i"), "j", a["aa"].alias("aa_i"), b["aa"].alias("aa_j"), known(a, b).alias("dist"), known(far("j"), far("k")).alias("turned"))
    near = F.least("dist", "turned")
    for name, f in (("hydro", C.hydrophobicity_delta), ("charge", C.charge_pair), ("polarity", C.polarity_pair)):
        out = out.withColumn(name, f(F.col("aa_i"), F.col("aa_j"), near, cutoff))
    return out if turned else out.drop("turned")


def map_cells_v1(residues: DataFrame, cutoff: float = 15.0) -> DataFrame:
    """What assemble_map_v1() gives of contact_maps_v1() with `turned`, in an order that takes less disk.

    Every distance stands in two cells: of its own pair below the diagonal, and above it of the pair whose rotated place this is. For each place
    the cells below come first, then those above with the same distances in the same order, so whoever writes them finds the second
    ones as copies; rows or columns are the same within each of the two.
    """
    n, k, j = F.col("n"), F.col("k"), F.col("j")
    many = n - 1 - k
    known = lambda x, y: F.coalesce(C.distance(x, y), F.lit(0.0))
    cells = _chain_starts(residues).select("*", F.explode(F.sequence(F.lit(0), 2 * many - 1)).alias("_t"))
    cells = cells.select("structure_id", *_SPOT, "a", "n", "k", (k + 1 + F.col("_t") % many).alias("j"), (F.col("_t") >= many).alias("_above"))
    pair = [F.when(F.col("_above"), far).otherwise(own) for own, far in ((k, n - 1 - j), (j, n - 1 - k))]
    cells = cells.select("structure_id", "_above", *[p.alias(c) for p, c in zip(pair, ("i", "j"), strict=True)], *[F.get("aa", p).alias(c) for p, c in zip(pair, ("aa_i", "aa_j"), strict=True)], known(F.col("a"), _at(j)).alias("dist"), known(_at(n - 1 - j), _at(n - 1 - k)).alias("turned"))
    side = lambda above, below, name: F.when(F.col("_above"), F.col(above)).otherwise(F.col(below)).alias(name)
    of = lambda f: f(F.col("aa_i"), F.col("aa_j"), F.least("dist", "turned"), cutoff)
    return cells.select(F.col("structure_id").alias("image_id"), side("i", "j", "row"), side("j", "i", "col"), "dist", of(C.hydrophobicity_delta).alias("hydro"), of(C.charge_pair).alias("charge"))


def channel_ranges(pairs: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Least and greatest value of each channel's whole square map, with the zeros of its empty cells."""
    ends = []
    for c in channels:
        ends += [F.least(F.min(c), F.lit(0.0)).alias(f"lo_{c}"), F.greatest(F.max(c), F.lit(0.0)).alias(f"hi_{c}")]
    return pairs.groupBy("structure_id").agg(*ends)


def _with_structures(pairs: DataFrame, structures: DataFrame) -> DataFrame:
    """Pairs with what is known of their structure. Each task looks its structures up: Spark takes pairs made of chains for as small as
    the chains and would broadcast them."""
    return pairs.join(structures.hint("shuffle_hash"), "structure_id")


def _byte(x: Column, lo: Column, hi: Column) -> Column:
    """0 to 255 between the ends, cut to a whole number; 0 where the ends are equal."""
    return F.when(hi > lo, F.floor((x - lo) * (1 / (hi - lo) * 255)).cast("int")).otherwise(0)


def normalize_maps(pairs: DataFrame, channels: tuple[str, ...] = UPPER + LOWER) -> DataFrame:
    """Pairs with each channel as 0..255 and bg_<channel>, the value of the map's empty cells."""
    ranged = _with_structures(pairs, channel_ranges(pairs, channels))
    for c in channels:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        ranged = ranged.withColumn(c, _byte(F.coalesce(F.col(c), F.lit(0.0)), lo, hi)).withColumn(f"bg_{c}", _byte(F.lit(0.0), lo, hi))
    return ranged.drop(*[f"{e}_{c}" for c in channels for e in ("lo", "hi")])


def normalize_maps_v1(pairs: DataFrame, channels: tuple[str, ...] = ("dist", "hydro")) -> DataFrame:
    """Pairs with each channel divided by the width of its range, the minimum not taken off; `turned`, if there, by that of dist."""
    ranged = _with_structures(pairs, channel_ranges(pairs, channels))
    for c in channels:
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        if c == "dist" and "turned" in pairs.columns:
            ranged = ranged.withColumn("turned", F.when(width != 0, F.col("turned") / width).otherwise(F.col("turned")))
        ranged = ranged.withColumn(c, F.when(width != 0, F.col(c) / width).otherwise(F.col(c)))
    return ranged.drop(*[f"{e}_{c}" for c in channels for e in ("lo", "hi")])


def rotate(df: DataFrame, n: str = "n") -> DataFrame:
    """Cells (row, col) turned by half a turn in a square of side n."""
    return df.withColumns({"row": F.col(n) - 1 - F.col("row"), "col": F.col(n) - 1 - F.col("col")})


#: Side of a tile of a map: maps of usual chains are one tile.
TILE = 256
_PIXELS = ("row", "col", "r", "g", "b")
_SIDES = (UPPER, LOWER)
_NONE = -1


def _filled_tiles(side: int) -> Callable:
    """Pixels of whole tiles out of rows sorted by structure, tile and head: a tile's head has its map's size, and the backgrounds where
    they are known beforehand, else those of the first pair hold."""

    def fill(table: pa.Table) -> pa.RecordBatch:
        top, left, size = (table[c].to_numpy() for c in ("top", "left", "size"))
        head = np.flatnonzero(size > 0)
        tile, more = np.cumsum(size > 0) - 1, np.diff(head, append=len(size)) > 1
        high, wide = (np.minimum(side, size[head] - c[head]).astype(np.int64) for c in (top, left))
        begin = np.concatenate(([0], np.cumsum(high * wide)))
        of = np.repeat(np.arange(len(head)), high * wide)
        row, column = np.divmod(np.arange(begin[-1]) - begin[of], wide[of])
        out = np.zeros((3, len(of)), np.int32)
        for k in (0, 1):
            at, v, ground = (table[f"{c}{k}"].to_numpy() for c in ("at", "v", "bg"))
            own = np.where((ground[head] < 0) & more, ground[np.minimum(head + 1, len(size) - 1)], ground[head])
            packed = np.maximum(own, 0)[of]
            cells = np.flatnonzero(at >= 0)
            r, c = np.divmod(at[cells], side)
            packed[begin[tile[cells]] + r * wide[tile[cells]] + c] = v[cells]
            for n in range(3):
                out[n] += (packed >> (16 - 8 * n)) & 255
        same = table["structure_id"].combine_chunks().take(pa.array(head[of]))
        place = (row + top[head][of], column + left[head][of])
        columns = [same.combine_chunks() if isinstance(same, pa.ChunkedArray) else same, *(pa.array(x.astype(np.int32)) for x in (*place, *(out & 255)))]
        return pa.RecordBatch.from_arrays(columns, ["image_id", *_PIXELS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            heads = np.flatnonzero(batch.column(3).to_numpy() > 0)
            if len(heads):
                done = [*held, batch.slice(0, heads[-1])]
                if sum(b.num_rows for b in done):
                    yield fill(pa.Table.from_batches(done))
                held = [batch.slice(heads[-1])]
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield fill(pa.Table.from_batches(held))

    return run


def _packed(names: list[str]) -> Column:
    """Three values modulo 256 as one whole number."""
    byte = lambda c: F.pmod(F.coalesce(c, F.lit(0)), F.lit(256)).cast("int")
    return byte(names[0]) * 65_536 + byte(names[1]) * 256 + byte(names[2])


def assemble_map(normalized: DataFrame, sizes: DataFrame) -> DataFrame:
    """pixels(image_id, row, col, r, g, b) of the whole square: the first three channels in place plus the other three
    turned by half a turn, modulo 256. normalized: of normalize_maps(); sizes: structure_id, n.

    A cell gets the pair's value where its pair stands and the map's background elsewhere, on both of the added sides. Maps are
    filled by tiles: each pair goes to the tiles of its two cells, in place and turned, which is the one exchange of pairs and one
    row where both lie in one tile. Backgrounds come with the pairs; they are looked up for maps of several tiles, of which some may have
    no pair. Runs a job to see whether there are such.
    """
    known = sizes.where("n > 0").select("structure_id", F.col("n").cast("int").alias("n"))
    grounds = [_packed([f"bg_{c}" for c in side]).alias(f"bg{k}") for k, side in enumerate(_SIDES)]
    edges = lambda: F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(TILE)))
    tiles = known.select("*", edges().alias("top")).select("*", edges().alias("left"))
    none = F.lit(_NONE)
    if known.where(F.col("n") > TILE).isEmpty():
        tiles = tiles.withColumns({f"bg{k}": none for k in (0, 1)})
    else:
        first = normalized.select("structure_id", *grounds).groupBy("structure_id").agg(*[F.first(f"bg{k}").alias(f"bg{k}") for k in (0, 1)])
        tiles = tiles.join(first, "structure_id", "left").fillna(0, ["bg0", "bg1"])
    tiles = tiles.select("structure_id", "top", "left", F.col("n").alias("size"), *[none.alias(f"{c}{k}") for k in (0, 1) for c in ("at", "v")], "bg0", "bg1")

    i, j, last = F.col("i"), F.col("j"), F.col("n") - 1
    edge = lambda x: (x - x % TILE).cast("int")
    inside = lambda r, c: (r % TILE * TILE + c % TILE).cast("int")
    spots = ((i, j), (last - i, last - j))
    pairs = _with_structures(normalized, known).select("structure_id", *[f(*spots[k]).alias(f"{n}{k}") for k in (0, 1) for n, f in (("top", lambda r, _: edge(r)), ("left", lambda _, c: edge(c)), ("at", inside))], *[_packed(list(side)).alias(f"v{k}") for k, side in enumerate(_SIDES)], *grounds)

    def part(k: int, both: bool) -> Column:
        at = [F.col(f"at{n}") if both or n == k else none for n in (0, 1)]
        return F.struct(F.col(f"top{k}").alias("top"), F.col(f"left{k}").alias("left"), *[a.alias(f"at{n}") for n, a in enumerate(at)])

    one = (F.col("top0") == F.col("top1")) & (F.col("left0") == F.col("left1"))
    sent = pairs.select("structure_id", "v0", "v1", "bg0", "bg1", F.inline(F.when(one, F.array(part(0, True))).otherwise(F.array(part(0, False), part(1, False)))))
    sent = sent.select("structure_id", "top", "left", F.lit(0).alias("size"), "at0", "v0", "at1", "v1", "bg0", "bg1")
    line = ["structure_id", "top", "left"]
    rows = tiles.unionByName(sent).repartition(*line).sortWithinPartitions(*line, F.col("size").desc())
    return rows.mapInArrow(_filled_tiles(TILE), f"image_id {dict(normalized.dtypes)['structure_id']}, " + ", ".join(f"{c} int" for c in _PIXELS))


#: Side of the largest map that a task makes in one piece; longer chains go by pairs and tiles.
WHOLE = 512
#: Bytes of pictures that a task hands on at once, about.
HELD = 8_000_000
_ENERGIES = ("vdw_att", "vdw_rep", "es_att", "es_rep")
#: Energies of a map made of its distances and hydrophobicities, as columns or as arrays.
Derive = Callable[[Any, Any], dict[str, Any]]


def _square(values: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """A channel's whole map of 0..255: the values where the pairs stand, the background elsewhere."""
    known = np.nan_to_num(values[upper], nan=0.0)
    lo, hi = min(known.min(initial=0.0), 0.0), max(known.max(initial=0.0), 0.0)
    out = np.zeros(upper.shape, np.int64)
    if hi > lo:
        scale = 1 / (hi - lo) * 255
        out[:] = np.floor((0.0 - lo) * scale)
        out[upper] = np.floor((known - lo) * scale)
    return out


def _picture(n: int, residues: pa.StructArray, energies: pa.StructArray | None, derive: Derive | None, cutoff: float) -> bytes:
    """Rows of blue, green and red bytes of one map."""
    at = residues.field("res_idx").to_numpy(zero_copy_only=False)
    place = np.empty((4, n))
    water = np.array([K.HYDROPHOBICITY.get(a, np.nan) for a in residues.field("aa").to_pylist()], np.float64)
    for k, values in enumerate((*(residues.field(c).to_numpy(zero_copy_only=False) for c in "xyz"), np.abs(water))):
        place[k, at] = values
    apart = place[:, :, None] - place[:, None, :]
    upper = np.triu(np.ones((n, n), bool), 1)
    dist = np.sqrt(apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2])
    hydro = np.where(dist < cutoff, np.nan_to_num(np.abs(apart[3]), nan=0.0), 0.0)
    channels = {"dist": dist, "hydro": hydro}
    if derive:
        channels |= derive(dist, hydro)
    else:
        known = energies is not None and len(energies) > 0
        i, j = (energies.field(c).to_numpy(zero_copy_only=False) for c in "ij") if known else (np.zeros(0, int),) * 2
        inside = (i >= 0) & (i < j) & (j < n)
        for c in _ENERGIES:
            channels[c] = np.zeros((n, n))
            if known:
                channels[c][i[inside], j[inside]] = energies.field(c).to_numpy(zero_copy_only=False)[inside]
    sides = [np.dstack([_square(channels[c], upper) for c in side[::-1]]) for side in _SIDES]
    return ((sides[0] + sides[1][::-1, ::-1]) & 255).astype(np.uint8).tobytes()


def map_images(residues: DataFrame, energies: DataFrame | None = None, derive: Derive | None = None, cutoff: float = 10.0) -> DataFrame:
    """images(image_id, height, width, data) of all structures, rows of blue, green and red bytes: what residue_pairs(),
    with_hydrophobicity(), normalize_maps(), assemble_map() and pack_pixels() give together.

    residues: of residue_index(), numbered from 0 without gaps. energies(structure_id, i, j, and the four terms; missing pairs are 0) or
    `derive`, which makes the terms of distance and hydrophobicity. A map is made in one piece of its chain's row, so nothing but residues
    and energies is exchanged; chains of more than WHOLE residues go by pairs and tiles. Runs a job for the longest chain.
    """
    longest = residues.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    spot = F.collect_list(F.struct(F.col("res_idx").cast("int").alias("res_idx"), "aa", *[F.col(c).cast("double").alias(c) for c in "xyz"]))
    chains = residues.groupBy("structure_id").agg(spot.alias("chain"), F.count(F.lit(1)).cast("int").alias("n"))
    small = chains.where(F.col("n") <= WHOLE) if longest > WHOLE else chains
    given = energies is not None
    if given:
        cells = F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), *[F.col(c).cast("double").alias(c) for c in _ENERGIES]))
        small = small.join(energies.groupBy("structure_id").agg(cells.alias("cells")), "structure_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chain, sides = batch.column("chain"), batch.column("n").to_pylist()
            met = [x.values if x.is_valid else None for x in batch.column("cells")] if given else [None] * len(sides)
            data: list[bytes] = []
            held, last = 0, len(sides) - 1
            for k, (n, x, y) in enumerate(zip(sides, chain, met, strict=True)):
                data.append(_picture(n, x.values, y, derive, cutoff))
                held += len(data[-1])
                if held >= HELD or k == last:
                    part = slice(k + 1 - len(data), k + 1)
                    yield pa.RecordBatch.from_arrays([batch.column("structure_id")[part], batch.column("n")[part], batch.column("n")[part], pa.array(data, pa.binary())], ["image_id", "height", "width", "data"])
                    data, held = [], 0

    images = small.mapInArrow(run, f"image_id {dict(residues.dtypes)['structure_id']}, height int, width int, data binary")
    if longest <= WHOLE:
        return images
    sizes = chains.where(F.col("n") > WHOLE).select("structure_id", "n")
    pairs = with_hydrophobicity(residue_pairs(residues.join(sizes, "structure_id", "left_semi")), cutoff)
    if derive:
        pairs = pairs.withColumns(derive(F.col("dist"), F.col("hydro")))
    elif given:
        pairs = materialize(pairs.join(energies.select("structure_id", "i", "j", *_ENERGIES), ["structure_id", "i", "j"], "left"))
    else:
        pairs = pairs.withColumns({c: F.lit(0.0) for c in _ENERGIES})
    return images.unionByName(pack_pixels(assemble_map(normalize_maps(pairs), sizes)))


def assemble_map_v1(maps: DataFrame, sizes: DataFrame) -> DataFrame:
    """cells(image_id, row, col, dist, hydro, charge) of the older version: distances below the diagonal in place and
    above it at the rotated place; the other channels on both sides. maps: of contact_maps_v1(), scaled. Where each pair comes with
    the distance at its rotated place (`turned`), nothing is exchanged."""
    if "turned" in maps.columns:
        side = lambda row, col, dist: F.struct(F.col(row).alias("row"), F.col(col).alias("col"), F.col(dist).alias("dist"), "hydro", "charge")
        return maps.select(F.col("structure_id").alias("image_id"), F.inline(F.array(side("j", "i", "dist"), side("i", "j", "turned"))))
    below = maps.select("structure_id", F.col("j").alias("row"), F.col("i").alias("col"), "dist", "hydro", "charge")
    above = maps.select("structure_id", F.col("i").alias("row"), F.col("j").alias("col"), "hydro", "charge")
    turned = rotate(below.join(sizes, "structure_id")).select("structure_id", "row", "col", "dist")
    cells = below.unionByName(above.join(turned, ["structure_id", "row", "col"]))
    return cells.withColumnRenamed("structure_id", "image_id")


def pack_pixels(pixels: DataFrame) -> DataFrame:
    """image_id, height, width, data (rows of blue, green and red bytes, as in Spark's image struct). One image is one row."""
    bgr = F.struct("row", "col", F.concat(*[F.lpad(F.hex(c), 2, "0") for c in ("b", "g", "r")]).alias("b"))
    rows = pixels.groupBy("image_id").agg(F.array_sort(F.collect_list(bgr)).alias("p"), (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return rows.select("image_id", "height", "width", F.unhex(F.array_join(F.transform("p", lambda x: x["b"]), "")).alias("data"))
