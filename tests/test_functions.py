"""Column functions on hand-worked cases."""

import numpy as np
from pyspark.sql import functions as F

from foldgrid import queries
from foldgrid.functions import chemistry, constants, facts, ids, numbers, vectors


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first().x


def test_ids(spark):
    p = F.col("p")
    assert one(spark, ids.stem(p), p="a/b.c/d1a3wa3.ent") == "d1a3wa3" and one(spark, ids.stem(p), p="x.tar.gz") == "x.tar" and one(spark, ids.stem(p), p=".hidden") == ".hidden"
    assert one(spark, ids.strip_structure_extension(p), p="q/d1.5.pdb") == "d1.5" and one(spark, ids.strip_structure_extension(p), p="d1.5") == "d1.5"
    assert one(spark, ids.pdb_chain(p), p="d1a3wa3") == "1A3W_A" and one(spark, ids.pdb_chain(p), p="d1a3w") is None
    assert one(spark, ids.pdb_chain_image(p), p="d1a3wb_") == "1A3W_B.jpg"
    assert one(spark, ids.foldseek_id(p), p="d1a7ia2A") == "d1a7ia2" and one(spark, ids.foldseek_id(p), p="x/d1a3wa3.ent") == "d1a3wa3"
    assert one(spark, ids.gtalign_query_id(p), p="o/d1a3wa3.ent.out") == "d1a3wa3" and one(spark, ids.gtalign_query_id(p), p="d1a3wa3.out") == "d1a3wa3"
    assert one(spark, ids.usalign_id(p), p="dir/d1a3wa3.ent:A") == "d1a3wa3"
    assert one(spark, ids.has_letter_chain(p), p="d1a3wa3") and not one(spark, ids.has_letter_chain(p), p="d1a3w_3")
    assert [one(spark, ids.level(p, n), p="a.1.2.3") for n in (1, 2, 3, 4)] == ["a", "a.1", "a.1.2", "a.1.2.3"]
    cell = one(spark, ids.score_cell(F.lit("a.jpg"), F.lit(0.93)))
    assert cell == "a.jpg,0.93" and one(spark, ids.cell_target(p), p=cell) == "a.jpg" and one(spark, ids.cell_score(p), p=cell) == 0.93
    assert one(spark, ids.cell_score(p), p="a.jpg") is None and one(spark, ids.cell_score(p), p="a,b") is None


def test_residues(spark):
    p = F.col("p")
    assert one(spark, chemistry.to_one_letter(p), p="ALA") == "A" and one(spark, chemistry.to_one_letter(p), p=" mse ") == "M" and one(spark, chemistry.to_one_letter(p), p="HOH") is None
    assert one(spark, chemistry.to_three_letter(p), p="w") == "TRP" and one(spark, chemistry.to_three_letter(p), p="?") == "UNK"
    assert one(spark, chemistry.standard_atom(F.lit("MSE"), F.lit("SE"))) == "SD" and one(spark, chemistry.standard_atom(F.lit("ALA"), F.lit("CA"))) == "CA"
    assert len(constants.RESIDUES) == 20 == len(constants.HYDROPHOBICITY) and len(constants.MODIFIED) == 25


def test_pair_functions(spark):
    near, far = F.lit(5.0), F.lit(10.0)
    assert one(spark, chemistry.hydrophobicity_delta(F.lit("D"), F.lit("A"), near, 10)) == 14 and one(spark, chemistry.hydrophobicity_delta(F.lit("D"), F.lit("A"), far, 10)) == 0
    assert one(spark, chemistry.hydrophobicity_delta(F.lit("X"), F.lit("A"), near, 10)) == 0
    assert one(spark, chemistry.charge_pair(F.lit("D"), F.lit("K"), near, 15)) == 1 and one(spark, chemistry.charge_pair(F.lit("A"), F.lit("K"), near, 15)) == 0
    assert one(spark, chemistry.polarity_pair(F.lit("D"), F.lit("K"), near, 15)) == 1 and one(spark, chemistry.polarity_pair(F.lit("A"), F.lit("K"), near, 15)) == 0
    assert abs(one(spark, chemistry.coulomb_term(F.lit(1.0), F.lit(-1.0), F.lit(0.5))) + 277.870912) < 1e-9
    att, rep = chemistry.lj_terms(F.lit(0.3), F.lit(0.3), F.lit(0.5), F.lit(0.5), F.lit(0.3))
    assert abs(one(spark, att) + 2) < 1e-12 and abs(one(spark, rep) - 2) < 1e-12
    att, rep = chemistry.lj_terms(F.lit(0.3), F.lit(0.3), F.lit(0.5), F.lit(0.5), F.lit(0.81))
    assert one(spark, att) == 0 == one(spark, rep)


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert abs(one(spark, vectors.cosine(a, a)) - 1) < 1e-12 and one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, vectors.argmax(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.7)))) == 1
    assert abs(sum(one(spark, vectors.softmax(F.array(F.lit(1000.0), F.lit(1001.0))))) - 1) < 1e-12


def test_facts(spark):
    whole = '{"rcsb_accession_info":{"deposit_date":"2020-01-01"},"rcsb_entry_info":{"experimental_method":"EM","molecular_weight":1.5,"disulfide_bond_count":0,"polymer_entity_count_protein":2}}'
    assert one(spark, facts.entry_facts(F.lit(whole))).disulfide_bonds == 0
    assert set(one(spark, facts.entry_facts(F.lit(whole.replace('"molecular_weight":1.5,', "")))).asDict().values()) == {None}
    assert set(one(spark, facts.entry_facts(F.lit(None).cast("string"))).asDict().values()) == {None}
    regions = '{"entries":[{"rcsb_uniprot_feature":[{"type":"TRANSMEMBRANE_REGION"},{"x":1},{"type":"TRANSMEMBRANE_REGION"}]},{"rcsb_uniprot_feature":[{"type":"TRANSMEMBRANE_REGION"}]}]}'
    assert one(spark, facts.transmembrane_count(F.lit(regions))) == 2 and one(spark, facts.transmembrane_count(F.lit('{"entries":[]}'))) == 0
    assert one(spark, facts.transmembrane_count(F.lit(None).cast("string"))) is None


def test_rounded_is_round(spark):
    rng = np.random.default_rng(1)
    halves = (rng.integers(-(10**9), 10**9, 20_000) * 10 + 5) / 1e7
    values = np.concatenate([rng.normal(size=20_000), rng.normal(size=20_000) * 1e4, rng.normal(size=2000) * 1e15, rng.normal(size=2000) * 1e-6, halves, np.nextafter(halves, 1e9), np.nextafter(halves, -1e9), [0.0, -0.0, -1e-9, -5e-7, 5e-7, 999.9999995, 1e300, -1e300, np.nan, np.inf, -np.inf]])
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    for digits in (0, 3, 6):
        odd = rows.where(~numbers.rounded(F.col("x"), digits).cast("string").eqNullSafe(F.round("x", digits).cast("string")))
        assert odd.collect() == []
    plan = queries._rounded(rows, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "FLOOR" in plan.upper() and dict(queries._rounded(rows.select(F.col("x").cast("float").alias("x")), "x").dtypes) == {"x": "float"}
