"""Energies of residue pairs from trajectory frames, and checks of energy logs.

frame_atoms(structure_id, frame, kind, res_idx, atom_idx, x, y, z, q, sigma, epsilon): nm, e, nm, kJ/mol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import chemistry as C
from ..functions import constants as K
from .common import materialize

FRAME = ["structure_id", "frame"]
TERMS = ("vdw_att", "vdw_rep", "es_att", "es_rep")


def _pair_terms(joined: DataFrame) -> DataFrame:
    """Columns r and the four energy terms of joined atoms (structs a, b)."""
    a, b = F.col("a"), F.col("b")
    joined = joined.withColumn("r", C.distance(a, b))
    att, rep = C.lj_terms(a["sigma"], b["sigma"], a["epsilon"], b["epsilon"], F.col("r"))
    joined = joined.withColumns({"vdw_att": att, "vdw_rep": rep, "es": C.coulomb_term(a["q"], b["q"], F.col("r"))})
    return joined.withColumns({"es_att": F.when(F.col("es") > 0, 0.0).otherwise(F.col("es")), "es_rep": F.when(F.col("es") > 0, F.col("es")).otherwise(0.0)})


def _residues(atoms: DataFrame) -> DataFrame:
    """One row a frame, which must fit it: `residues`, an array of the protein's residues (res_idx, atoms), and `others`, its solvent and
    ions. Atoms are exchanged once, by frame, and what is summed by frame or within it afterwards needs no further exchange."""
    atom, protein = F.struct("x", "y", "z", "q", "sigma", "epsilon"), F.col("kind") == "protein"
    dealt = atoms.select(*FRAME, F.when(protein, F.col("res_idx")).alias("res_idx"), protein.alias("_p"), atom.alias("_atom")).repartition(*FRAME)
    each = dealt.groupBy(*FRAME, "_p", "res_idx").agg(F.collect_list("_atom").alias("atoms"))
    residue = F.when(F.col("_p"), F.struct("res_idx", "atoms"))
    return each.groupBy(*FRAME).agg(F.collect_list(residue).alias("residues"), F.flatten(F.collect_list(F.when(~F.col("_p"), F.col("atoms")))).alias("others"))


def _pairs_of_rows(frame_atoms: DataFrame) -> DataFrame:
    """Atom pairs with their terms and the numbers of atoms of both residues, n_i and n_j, made of a frame's row, so what is summed by
    frame or within it needs no further exchange."""
    frames = _residues(frame_atoms.where("kind = 'protein'"))
    one = frames.select(*FRAME, "residues", F.explode("residues").alias("_i"))
    two = one.select(*FRAME, "_i", F.explode("residues").alias("_j")).where("_i.res_idx < _j.res_idx")
    two = two.select(*FRAME, F.col("_i.res_idx").alias("i"), F.col("_j.res_idx").alias("j"), F.col("_i.atoms").alias("_a"), F.col("_j.atoms").alias("_b"))
    counts = [F.size("_a").cast("long").alias("n_i"), F.size("_b").cast("long").alias("n_j")]
    pairs = two.select(*FRAME, "i", "j", *counts, "_b", F.explode("_a").alias("a")).select(*FRAME, "i", "j", "n_i", "n_j", "a", F.explode("_b").alias("b"))
    return _pair_terms(pairs).where(F.col("r") >= K.CLOSEST).select(*FRAME, "i", "j", "r", *TERMS, "n_i", "n_j")


def atom_pair_energies(frame_atoms: DataFrame, sizes: bool = False) -> DataFrame:
    """(structure_id, frame, i, j, r, terms) of atom pairs of different protein residues, i < j, no closer than 0.1 nm.

    Atoms are exchanged once, by frame, and joined with nothing; a task makes the pairs of many frames by array arithmetic, CELLS of them
    at a time. `sizes` adds the numbers of atoms of both residues, n_i and n_j, and keeps the pairs dealt by frame for sums.
    """
    if sizes:
        return _pairs_of_rows(frame_atoms)
    kinds = dict(frame_atoms.dtypes)
    schema = f"structure_id {kinds['structure_id']}, frame {kinds['frame']}, i {kinds['res_idx']}, j {kinds['res_idx']}, r double, " + ", ".join(f"{t} double" for t in TERMS)
    met = frame_atoms.where("kind = 'protein' AND res_idx IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(*FRAME).orderBy("res_idx"))
    atoms = met.select(*FRAME, "res_idx", *[F.col(c).cast("double") for c in _FIELDS], place.alias("place"))
    return atoms.mapInArrow(_atom_pairs(to_arrow_schema(StructType.fromDDL(schema))), schema)


def residue_pair_energy(pairs: DataFrame, frame_atoms: DataFrame) -> DataFrame:
    """Sums over the atom pairs of each residue pair, divided by the numbers of their atoms (skipped pairs included), which the pairs
    bring along or which are joined."""
    if "n_i" in pairs.columns:
        sums = pairs.groupBy(*FRAME, "i", "j").agg(*[F.sum(t).alias(t) for t in TERMS], F.max("n_i").alias("n_i"), F.max("n_j").alias("n_j"))
        return sums.select(*FRAME, "i", "j", *[(F.col(t) / (F.col("n_i") * F.col("n_j"))).alias(t) for t in TERMS])
    sizes = frame_atoms.where("kind = 'protein'").groupBy(*FRAME, "res_idx").agg(F.count(F.lit(1)).alias("size"))
    a = sizes.select(*FRAME, F.col("res_idx").alias("i"), F.col("size").alias("n_i"))
    b = sizes.select(*FRAME, F.col("res_idx").alias("j"), F.col("size").alias("n_j"))
    sums = pairs.groupBy(*FRAME, "i", "j").agg(*[F.sum(t).alias(t) for t in TERMS])
    joined = sums.join(a, [*FRAME, "i"]).join(b, [*FRAME, "j"])
    return joined.select(*FRAME, "i", "j", *[(F.col(t) / (F.col("n_i") * F.col("n_j"))).alias(t) for t in TERMS])


def residue_solvent_energies(frame_atoms: DataFrame) -> DataFrame:
    """(structure_id, frame, res_idx, vdw_solv, es_solv): protein atoms against solvent and ions beyond 0.1 nm, divided
    by the residue's atoms."""
    one = _residues(frame_atoms).select(*FRAME, "others", F.explode("residues").alias("_i"))
    one = one.select(*FRAME, "others", F.col("_i.res_idx").alias("res_idx"), F.size("_i.atoms").alias("size"), F.explode("_i.atoms").alias("a"))
    met = _pair_terms(one.select(*FRAME, "res_idx", "size", "a", F.explode_outer("others").alias("b")))
    far = lambda c: F.sum(F.when(F.col("r") > K.CLOSEST, c))
    sums = met.groupBy(*FRAME, "res_idx").agg(far(F.col("vdw_att") + F.col("vdw_rep")).alias("vdw"), far(F.col("es")).alias("es"), F.max("size").alias("size"))
    per = lambda c: F.coalesce(F.col(c) / F.col("size"), F.lit(0.0))
    return sums.select(*FRAME, "res_idx", per("vdw").alias("vdw_solv"), per("es").alias("es_solv"))


def subtract_solvent(pair_energy: DataFrame, residue_energy: DataFrame) -> DataFrame:
    """Attractive terms less the mean solvent energy of both residues. residue_energy: one row a residue; they are looked up in their
    frame, so what is dealt by frame isn't exchanged again."""
    own = F.struct("res_idx", F.struct("vdw_solv", "es_solv"))
    frames = residue_energy.where("res_idx IS NOT NULL").groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(own)).alias("_solv"))
    joined = pair_energy.join(frames.hint("shuffle_hash"), FRAME, "left")
    mean = lambda c: sum(F.coalesce(F.try_element_at("_solv", F.col(r))[c], F.lit(0.0)) for r in ("i", "j")) / 2
    joined = joined.withColumns({"vdw_att": F.col("vdw_att") - mean("vdw_solv"), "es_att": F.col("es_att") - mean("es_solv")})
    return joined.select(*FRAME, "i", "j", *TERMS)


def frame_average(values: DataFrame, frames: DataFrame, columns: tuple[str, ...] = TERMS) -> DataFrame:
    """Means over all frames of a structure (frames: structure_id, n_frames); a cell that a frame lacks counts as 0. Counts are looked up:
    sums, of which there are many more, needn't be sorted."""
    sums = values.groupBy("structure_id", "i", "j").agg(*[F.sum(c).alias(c) for c in columns])
    return sums.join(frames.hint("shuffle_hash"), "structure_id").select("structure_id", "i", "j", *[(F.col(c) / F.col("n_frames")).alias(c) for c in columns])


def frame_counts(frame_atoms: DataFrame) -> DataFrame:
    return frame_atoms.groupBy("structure_id").agg(F.count_distinct("frame").alias("n_frames"))


#: Atom pairs that a task holds at once (few, so that their columns stay in a core's cache), and atoms beyond which a frame is split.
CELLS, CROWD = 16_384, 4096
_FIELDS = ("x", "y", "z", "q", "sigma", "epsilon")
_ATOM = ["res_idx", *_FIELDS]


def _terms(a: list[np.ndarray], b: list[np.ndarray], strict: bool) -> tuple[np.ndarray, ...]:
    """Attractive, repulsive and Coulomb terms of atoms with atoms (columns of _FIELDS), 0 where they are too close; and whether they count."""
    r = np.zeros(len(a[0]))
    for m, n in zip(a[:3], b[:3], strict=True):
        d = m - n
        d *= d
        r += d
    np.sqrt(r, out=r)
    ok = r > K.CLOSEST if strict else r >= K.CLOSEST
    es = K.COULOMB * a[3]
    es *= b[3]
    near = ok & (r <= K.LJ_CUTOFF)
    if not ok.all():
        es[~ok], r[~ok] = 0.0, 1.0
    es /= r
    att, rep = np.zeros((2, len(r)))
    near = np.flatnonzero(near)
    s2 = (a[4].take(near) + b[4].take(near)) / 2 / r.take(near)
    s2 *= s2
    s6 = s2 * s2 * s2
    deep = 4 * np.sqrt(a[5].take(near) * b[5].take(near)) * s6
    att[near], rep[near] = -deep, deep * s6
    return att, rep, es, ok


def _met(own: np.ndarray, first: int, last: int, count: np.ndarray, atoms: np.ndarray, b: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of own atoms first to last, each as often as it meets another, and of the atoms at b that they meet."""
    return [np.repeat(x[first:last], count[first:last]) for x in own], [x.take(b) for x in atoms]


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... for count[k] places, in a row."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _stretches(cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of items whose costs stay within CELLS (one item at least)."""
    total, first = np.cumsum(cost), 0
    while first < len(cost):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + CELLS, side="right")))
        yield first, last
        first = last


class _Residues:
    """Atoms in order of frame and residue, with the bounds of residues and frames."""

    def __init__(self, frame: np.ndarray, residue: np.ndarray) -> None:
        new = (np.diff(frame, prepend=-1) != 0) | (np.diff(residue, prepend=residue[:1] - 1) != 0) if len(frame) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.size = np.diff(self.first, append=len(frame))
        self.name, self.frame = residue[self.first], frame[self.first]
        self.of = np.cumsum(new) - 1


def _pair_sums(own: np.ndarray, mine: _Residues, atoms: np.ndarray, all_: _Residues) -> tuple[np.ndarray, ...]:
    """Residue of own, residue of atoms, and sums of the terms over the atom pairs that count, of all pairs in one frame of a residue
    with a later one. Pairs of many frames, or a stretch of one, are made in one go."""
    least = min(all_.name.min(initial=0), mine.name.min(initial=0))
    span = np.int64(max(all_.name.max(initial=0), mine.name.max(initial=0)) - least + 1)
    later = np.searchsorted(all_.frame * span + (all_.name - least), mine.frame * span + (mine.name - least), side="right")
    hi = np.searchsorted(all_.frame, mine.frame, side="right")
    begin = np.append(all_.first, atoms.shape[1])
    count, start = np.repeat(begin[hi] - begin[later], mine.size), np.repeat(begin[later], mine.size)
    found = []
    for first, last in _stretches(count):
        b = _spread(start[first:last], count[first:last])
        if not len(b):
            continue
        att, rep, es, ok = _terms(*_met(own, first, last, count, atoms, b), False)
        code = np.repeat(mine.of[first:last] * np.int64(len(all_.first)), count[first:last]) + all_.of.take(b)
        new = np.flatnonzero(np.diff(code, prepend=-1))
        sums = [np.logical_or.reduceat(ok, new), *(np.add.reduceat(x, new) for x in (att, rep, np.minimum(es, 0), np.maximum(es, 0)))]
        found.append((code[new], *sums))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 4
    code, *sums = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(code, kind="stable")  # one pair of residues stands once for each atom of the first
    new = np.flatnonzero(np.diff(code[order], prepend=-1))
    sums = [np.add.reduceat(x[order], new) for x in sums]
    met = sums[0] > 0
    i, j = np.divmod(code[order][new][met], len(all_.first))
    return i, j, *(x[met] for x in sums[1:])


def _solvent_sums(own: np.ndarray, mine: _Residues, water: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of van der Waals and Coulomb terms of each residue with the solvent (in order of its frames)."""
    lo, hi = (np.repeat(np.searchsorted(frame, mine.frame, side=side), mine.size) for side in ("left", "right"))
    out, count = np.zeros((2, own.shape[1])), hi - lo
    for first, last in _stretches(count):
        n = count[first:last]
        att, rep, es, _ = _terms(*_met(own, first, last, count, water, _spread(lo[first:last], n)), True)
        att += rep
        some = np.flatnonzero(n)  # those that meet any
        for k, x in enumerate((att, es)):
            out[k, first + some] = np.add.reduceat(x, (np.cumsum(n) - n)[some]) if len(some) else 0.0
    return tuple(np.add.reduceat(x, mine.first) if len(mine.first) else x[:0] for x in out)


def _sorted_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole frames out of sorted batches, many in one table, with each row's frame by number. A frame begins at each place 1."""
    held: list[pa.RecordBatch] = []

    def number(table: pa.Table) -> np.ndarray:
        return np.cumsum(table["place"].to_numpy() == 1) - 1

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        group = number(table)
        done = int(np.searchsorted(group, group[-1]))
        if done:
            yield table.slice(0, done), group[:done]
        held = table.slice(done).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, number(table)


def _matrix(table: pa.Table, rows: np.ndarray) -> np.ndarray:
    return np.array([table[c].to_numpy()[rows] for c in _FIELDS], np.float64).reshape(len(_FIELDS), len(rows))


def _atom_pairs(schema: pa.Schema):  # noqa: ANN202
    """Rows of atom pairs, some CELLS at a time, with the terms as _pair_terms() has them, nulls and NaN included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _sorted_frames(batches):
            atoms, res = _matrix(table, np.arange(len(table))), _Residues(group, table["res_idx"].to_numpy())
            unknown = {c: table[c].is_null().to_numpy() for c in _FIELDS if table[c].null_count}
            lost = [sum((unknown.get(c, np.zeros(len(table), bool)) for c in some), np.zeros(len(table), bool)) for some in (("q",), ("sigma", "epsilon"))]
            same, name = [table[c].combine_chunks() for c in FRAME], res.name[res.of]
            begin = np.append(res.first, len(table))[res.of + 1]  # of the next residue
            count = np.searchsorted(group, group, side="right") - begin
            for first, last in _stretches(count):
                a, b = np.repeat(np.arange(first, last), count[first:last]), _spread(begin[first:last], count[first:last])
                r = np.sqrt(sum((x.take(a) - x.take(b)) ** 2 for x in atoms[:3]))
                if (r < K.CLOSEST).any():
                    far = np.flatnonzero(~(r < K.CLOSEST))
                    a, b, r = a[far], b[far], r[far]
                if not len(r):
                    continue
                q, sigma, epsilon = ((x.take(a), x.take(b)) for x in atoms[3:])
                near = r <= K.LJ_CUTOFF
                with np.errstate(invalid="ignore", over="ignore"):
                    s = (sigma[0] + sigma[1]) / 2 / r
                    s6, deep = s * s * s * s * s * s, np.sqrt(epsilon[0] * epsilon[1]) * 4
                    att, rep = np.where(near, -deep * s6, 0.0), np.where(near, deep * s6 * s6, 0.0)
                    es = K.COULOMB * q[0] * q[1] / r
                blank = [None] * 4
                if unknown:
                    without, shallow = (x[a] | x[b] for x in lost)
                    es[without] = 0.0
                    blank = [shallow & near, shallow & near, without, None]
                apart = ~(es <= 0)
                terms = (att, rep, np.where(apart, 0.0, es), np.where(apart, es, 0.0))
                at = pa.array(a)
                columns = [*(c.take(at) for c in same), *(pa.array(x, f.type) for x, f in zip((name[a], name[b], r), list(schema)[2:5], strict=True)), *(pa.array(x, mask=m) for x, m in zip(terms, blank, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _whole_frames(subtract: bool, schema: pa.Schema):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _sorted_frames(batches):
            role = table["role"].to_numpy()
            protein, solvent = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            atoms, res = _matrix(table, protein), _Residues(group[protein], table["res_idx"].to_numpy()[protein])
            i, j, *values = _pair_sums(atoms, res, atoms, res)
            values = [x / (res.size[i] * res.size[j]) for x in values]
            if subtract:
                for k, x in zip((0, 2), _solvent_sums(atoms, res, _matrix(table, solvent), group[solvent]), strict=True):
                    mean = x / res.size
                    values[k] = values[k] - (mean[i] + mean[j]) / 2
            same = pa.array(protein[res.first[i]])
            columns = [*(table[c].take(same).combine_chunks() for c in FRAME), res.name[i], res.name[j], *values]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _stretch(schema: pa.Schema):  # noqa: ANN202
    """Sums of one stretch of residues at a time: its own atoms come first and are held, the frame's others come in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, own, mine = None, [], None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = list(zip(*[table[c].to_pylist() for c in (*FRAME, "stretch", "role")], strict=True))
            first = 0
            while first < len(marks):
                last = first + 1
                while last < len(marks) and marks[last] == marks[first]:
                    last += 1
                part, mark = table.slice(first, last - first), marks[first]
                first = last
                if mark[:3] != key:
                    key, held, own = mark[:3], [], None
                if mark[3] == 0:
                    held.append(part)
                    continue
                if not held:  # no residue falls to this stretch
                    continue
                if own is None:
                    whole = pa.concat_tables(held)
                    own = _matrix(whole, np.arange(len(whole)))
                    mine = _Residues(np.zeros(len(whole), np.int64), whole["res_idx"].to_numpy())
                other, rows = np.zeros(len(part), np.int64), _matrix(part, np.arange(len(part)))
                if mark[3] == 1:
                    res = _Residues(other, part["res_idx"].to_numpy())
                    i, j, *values = _pair_sums(own, mine, rows, res)
                    i, j = mine.name[i], res.name[j]
                else:
                    vdw, es = _solvent_sums(own, mine, rows, other)
                    i, values = mine.name, [vdw, np.zeros(len(vdw)), es, np.zeros(len(vdw))]
                    j = np.full(len(i), -1)
                same = [pa.array([v] * len(i), f.type) for v, f in zip(mark[:2], schema, strict=False)]
                kinds = list(schema)[2:]
                yield pa.RecordBatch.from_arrays([*same, pa.array([mark[3] == 2] * len(i)), *(pa.array(c, f.type) for c, f in zip((i, j, *values), kinds[1:], strict=True))], schema=schema)

    return run


def _split_frames(atoms: DataFrame, large: DataFrame, subtract: bool, schema: str) -> DataFrame:
    """Energies of frames that are too large for a task: each stretch of residues is one, and what needs two of them is joined."""
    atoms = atoms.join(large, FRAME).withColumn("_n", F.ceil(F.col("size") / CROWD).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("stretch")
    protein = atoms.where("role = 0")
    mine = protein.select(*FRAME, F.pmod("res_idx", "_n").cast("int").alias("stretch"), F.lit(0).alias("role"), *_ATOM)
    others = atoms.select(*FRAME, every, (F.col("role") + 1).alias("role"), *_ATOM)
    line = [*FRAME, "stretch"]
    rows = mine.unionByName(others).repartition(*line).sortWithinPartitions(*line, "role", *_ATOM)
    first, last = schema.split(", i int", 1)
    parts = materialize(rows.mapInArrow(_stretch(to_arrow_schema(StructType.fromDDL(f"{first}, wet boolean, i int{last}"))), f"{first}, wet boolean, i int{last}"))
    sizes = protein.groupBy(*FRAME, "res_idx").agg(F.count(F.lit(1)).alias("n"))
    size = lambda r: sizes.select(*FRAME, F.col("res_idx").alias(r), F.col("n").alias(f"n_{r}"))
    sums = parts.where("NOT wet").groupBy(*FRAME, "i", "j").agg(*[F.sum(t).alias(t) for t in TERMS]).join(size("i"), [*FRAME, "i"]).join(size("j"), [*FRAME, "j"])
    pairs = sums.select(*FRAME, "i", "j", *[(F.col(t) / (F.col("n_i") * F.col("n_j"))).alias(t) for t in TERMS])
    if not subtract:
        return pairs
    wet = parts.where("wet").groupBy(*FRAME, "i").agg(F.sum("vdw_att").alias("v"), F.sum("es_att").alias("e")).join(size("i"), [*FRAME, "i"])
    return subtract_solvent(pairs, wet.select(*FRAME, F.col("i").alias("res_idx"), (F.col("v") / F.col("n_i")).alias("vdw_solv"), (F.col("e") / F.col("n_i")).alias("es_solv")))


def frame_energies(frame_atoms: DataFrame, subtract: bool = True) -> DataFrame:
    """Residue-pair energies of each frame by array arithmetic: what atom_pair_energies(), residue_pair_energy(),
    residue_solvent_energies() and subtract_solvent() give together.

    Atoms lie in order of frame, residue and their own values, so sums don't depend on how they came and no number of an atom is read. All whole frames of a batch are taken together by segments. A frame of more than CROWD
    atoms is split by residues into stretches that are tasks of their own; such a task holds its stretch and one batch of the
    frame's other atoms. Runs a job that counts the atoms of each frame.
    """
    kinds = dict(frame_atoms.dtypes)
    schema = f"structure_id {kinds['structure_id']}, frame {kinds['frame']}, i int, j int, " + ", ".join(f"{t} double" for t in TERMS)
    role = F.when(F.col("kind") == "protein", 0).otherwise(1).alias("role")
    chosen = frame_atoms.select(*FRAME, role, "res_idx", *[F.col(c).cast("double") for c in _FIELDS])
    sizes = materialize(frame_atoms.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CROWD))
    split = not sizes.isEmpty()
    small = chosen.join(sizes, FRAME, "left_anti") if split else chosen
    place = F.row_number().over(Window.partitionBy(*FRAME).orderBy("role", *_ATOM))  # exchanges nothing where frames are together already
    small = small.withColumn("place", place)
    whole = small.mapInArrow(_whole_frames(subtract, to_arrow_schema(StructType.fromDDL(schema))), schema)
    return whole.unionByName(_split_frames(chosen, sizes, subtract, schema)) if split else whole


def energy_stats(log: DataFrame, unsteady: float = 0.05) -> DataFrame:
    """First, last, mean, population deviation, ends and mean per atom of each run and stage; unsteady above 5 % of the mean."""
    e = F.col("energy_kj")
    out = log.groupBy("run_id", "stage").agg(
        F.min_by("energy_kj", "step").alias("initial"),
        F.max_by("energy_kj", "step").alias("final"),
        F.avg(e).alias("mean"),
        F.stddev_pop(e).alias("std"),
        F.min(e).alias("least"),
        F.max(e).alias("greatest"),
        F.avg(e / F.col("n_atoms")).alias("mean_per_atom"),
    )
    return out.withColumn("unsteady", F.col("std") > F.abs("mean") * unsteady)


#: stage, skip_first: the first comparison is passed over; compare: with the energy before; every: frames between tests.
STAGE_RULES = {"npt": (True, True, 1), "nvt": (False, False, 1), "nvt_steady": (False, True, 1), "production": (False, True, 10)}


def energy_checks(log: DataFrame, rules: dict[str, tuple[bool, bool, int]] = STAGE_RULES) -> DataFrame:
    """Log entries that are tested, with flags. A stage without a rule is tested at every step against the one before."""
    order = Window.partitionBy("run_id", "stage").orderBy("step")
    pick = lambda k, default: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for s, r in rules.items() for x in (s, r[k])]), F.col("stage")), F.lit(default))
    rows = log.withColumn("nth", F.row_number().over(order)).withColumn("_before", F.lag("energy_kj").over(order))
    compared: Column = pick(1, True) & (~pick(0, False) | (F.col("nth") > 2))
    before, e = F.when(compared, F.col("_before")), F.col("energy_kj")
    rows = rows.where(F.col("nth") % pick(2, 1) == 0)
    per_atom = F.when(F.col("n_atoms") > 0, e / F.col("n_atoms"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.select(
        "run_id",
        "stage",
        "step",
        "energy_kj",
        flag(e > 0).alias("positive"),
        flag((before < 0) & (e - before > F.abs(before) * 0.1)).alias("rise"),
        flag(F.abs(e - before) > 100_000).alias("jump"),
        flag(per_atom > 0).alias("positive_per_atom"),
        flag(per_atom < -50).alias("low_per_atom"),
    )


def npt_trend(log: DataFrame) -> DataFrame:
    """Whether the npt stage of each run ends higher than it began, or above 100 per atom."""
    rows = log.where("stage = 'npt'").groupBy("run_id").agg(F.min_by("energy_kj", "step").alias("initial"), F.max_by("energy_kj", "step").alias("final"), F.max("n_atoms").alias("n_atoms"))
    return rows.withColumns({"rose": F.col("final") > F.col("initial"), "exploded": F.col("final") / F.col("n_atoms") > 100})


def stage_timeline(log: DataFrame, stages: list[str]) -> DataFrame:
    """Entries with their time since the run's start, stages in order (those of one point take no time), and each
    stage's energy change from first to last."""
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    ends = log.groupBy("run_id", "stage").agg(
        F.max_by("time_ps", "step").alias("last"), F.count(F.lit(1)).alias("points"), (F.max_by("energy_kj", "step") - F.min_by("energy_kj", "step")).alias("change")
    )
    order = Window.partitionBy("run_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_place", place).where("_place > 0").withColumn("_took", F.when(F.col("points") > 1, F.col("last")).otherwise(0.0))
    ends = ends.select("run_id", "stage", F.coalesce(F.sum("_took").over(order), F.lit(0.0)).alias("offset"), "change")
    return log.join(ends, ["run_id", "stage"]).withColumn("total_ps", F.col("time_ps") + F.col("offset"))
