"""Names of structures, chains and hits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of structure and image files.
EXTENSIONS = r"\.(ent|pdb|cif|jpg|jpeg|png)$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Basename without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def strip_structure_extension(path: Column) -> Column:
    """Basename without one of the known extensions; other dots stay."""
    return F.regexp_replace(basename(path), EXTENSIONS, "")


def pdb_id(sid: Column) -> Column:
    """Characters 2 to 5 of a domain id in upper case; null when it has fewer than six."""
    return F.when(F.length(sid) >= 6, F.upper(F.substring(sid, 2, 4)))


def chain_id(sid: Column) -> Column:
    """Character 6 of a domain id in upper case; null when it has fewer."""
    return F.when(F.length(sid) >= 6, F.upper(F.substring(sid, 6, 1)))


def pdb_chain(sid: Column) -> Column:
    """PDB_CHAIN, under which the domains of a chain coincide."""
    return F.concat(pdb_id(sid), F.lit("_"), chain_id(sid))


def pdb_chain_image(sid: Column) -> Column:
    return F.concat(pdb_chain(sid), F.lit(".jpg"))


def has_letter_chain(sid: Column) -> Column:
    return F.upper(sid).rlike("^.{5}[A-Z]")


def foldseek_id(raw: Column) -> Column:
    return F.substring(stem(raw), 1, 7)


def gtalign_query_id(name: Column) -> Column:
    return F.substring(F.regexp_replace(basename(name), r"(\.ent)?\.out$", ""), 1, 7)


def usalign_id(raw: Column) -> Column:
    """Stem of the file before the chain's colon."""
    return stem(F.substring_index(basename(raw), ":", 1))


def level(sccs: Column, parts: int) -> Column:
    """First parts of a dotted classification: 1 class, 2 fold, 3 superfamily, 4 family."""
    return F.substring_index(sccs, ".", parts)


def score_cell(target: Column, score: Column) -> Column:
    return F.concat_ws(",", target, score.cast("string"))


def cell_target(cell: Column) -> Column:
    return F.substring_index(cell, ",", 1)


def cell_score(cell: Column) -> Column:
    return F.regexp_extract(cell, r"^[^,]*,(.*)$", 1).try_cast("double")
