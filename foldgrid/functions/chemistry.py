"""Residue chemistry and atom-pair energies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def standard_name(res_name: Column) -> Column:
    """Three-letter name, modified residues as the standard one they count as."""
    name = F.upper(F.trim(res_name))
    return F.coalesce(F.try_element_at(_map(K.MODIFIED), name), name)


def standard_atom(res_name: Column, atom_name: Column) -> Column:
    """Selenium of selenomethionine counts as sulphur."""
    return F.when((F.upper(res_name) == "MSE") & (atom_name == "SE"), F.lit("SD")).otherwise(atom_name)


def to_one_letter(res_name: Column) -> Column:
    """One letter for standard and modified residues; null for all others."""
    known = {v: k for k, v in K.RESIDUES.items()}
    codes, name = _map(known | {m: known[v] for m, v in K.MODIFIED.items()}), F.trim(res_name)
    return F.coalesce(F.try_element_at(codes, name), F.try_element_at(codes, F.upper(name)))  # mostly in upper case already


def to_three_letter(aa: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(K.RESIDUES), aa), F.try_element_at(_map(K.RESIDUES), F.upper(aa)), F.lit(K.UNKNOWN_RESIDUE))


def _by_letter(aa: Column, values: dict) -> Column:
    """The value of a letter, found by its place: made for each residue of each pair, where a map's keys would be gone through."""
    place = F.instr(F.lit("".join(values)), aa)
    return F.when((F.length(aa) == 1) & (place > 0), F.get(F.array(*[F.lit(v) for v in values.values()]), place - 1))


def hydrophobicity(aa: Column) -> Column:
    return _by_letter(aa, K.HYDROPHOBICITY)


def charge(aa: Column) -> Column:
    return _by_letter(aa, {a: 1 if a in K.POSITIVE else -1 if a in K.NEGATIVE else K.NEUTRAL for a in K.RESIDUES})


def polarity(aa: Column) -> Column:
    return _by_letter(aa, {a: int(a in K.HYDROPHILIC) for a in K.RESIDUES})


def distance(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Euclidean distance of two structs with x, y, z; scale 10 turns nm into Angstrom."""
    squares = sum(((a[k] - b[k]) * (a[k] - b[k]) for k in ("y", "z")), (a["x"] - b["x"]) * (a["x"] - b["x"]))
    return F.sqrt(squares) * scale


def hydrophobicity_delta(aa1: Column, aa2: Column, dist: Column, cutoff: float) -> Column:
    """Difference of absolute hydrophobicities of residues in contact, else 0 (also for unknown residues)."""
    delta = F.abs(F.abs(hydrophobicity(aa1)) - F.abs(hydrophobicity(aa2)))
    return F.when(dist < cutoff, F.coalesce(delta, F.lit(0))).otherwise(0).cast("double")


def charge_pair(aa1: Column, aa2: Column, dist: Column, cutoff: float) -> Column:
    return F.when((dist < cutoff) & (charge(aa1) * charge(aa2) == -1), 1).otherwise(0).cast("double")


def polarity_pair(aa1: Column, aa2: Column, dist: Column, cutoff: float) -> Column:
    return F.when((dist < cutoff) & (polarity(aa1) == polarity(aa2)), 1).otherwise(0).cast("double")


def lj_terms(sigma1: Column, sigma2: Column, eps1: Column, eps2: Column, r: Column) -> tuple[Column, Column]:
    """(attractive, repulsive) Lennard-Jones terms by mean sigma and geometric mean epsilon, 0 beyond the cutoff."""
    s = (sigma1 + sigma2) / 2 / r
    s6 = s * s * s * s * s * s
    deep = F.sqrt(eps1 * eps2) * 4
    near = r <= K.LJ_CUTOFF
    return F.when(near, -deep * s6).otherwise(0.0), F.when(near, deep * s6 * s6).otherwise(0.0)


def coulomb_term(q1: Column, q2: Column, r: Column) -> Column:
    return F.lit(K.COULOMB) * q1 * q2 / r
