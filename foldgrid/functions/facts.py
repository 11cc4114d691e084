"""Facts from pre-fetched JSON answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY = """rcsb_accession_info struct<deposit_date string>,
rcsb_entry_info struct<experimental_method string, molecular_weight double, disulfide_bond_count int, polymer_entity_count_protein int>"""
FEATURES = "entries array<struct<rcsb_uniprot_feature array<struct<type string>>>>"


def entry_facts(json: Column) -> Column:
    """struct of the five entry facts; one missing key makes all of them null."""
    e = F.from_json(json, ENTRY)
    a, b = e["rcsb_accession_info"], e["rcsb_entry_info"]
    facts = {
        "deposit_date": a["deposit_date"],
        "experimental_method": b["experimental_method"],
        "molecular_weight": b["molecular_weight"],
        "disulfide_bonds": b["disulfide_bond_count"],
        "protein_entities": b["polymer_entity_count_protein"],
    }
    complete = F.lit(True)
    for x in facts.values():
        complete = complete & x.isNotNull()
    return F.struct(*[F.when(complete, x).alias(k) for k, x in facts.items()])


def transmembrane_count(json: Column) -> Column:
    """Transmembrane regions of the first entry; null when there is no answer."""
    first = F.get(F.from_json(json, FEATURES)["entries"], F.lit(0))["rcsb_uniprot_feature"]
    regions = F.filter(first, lambda x: x["type"] == "TRANSMEMBRANE_REGION")
    return F.when(json.isNotNull(), F.coalesce(F.size(regions), F.lit(0)))
