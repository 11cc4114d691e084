"""Readers and writers on small files."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldgrid.operators import filters, images, joins, maps, search
from foldgrid.sources import files, results, structures, text


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return str(path)


def test_lists(spark, tmp_path):
    got = text.read_id_list(spark, write(tmp_path / "eval.lst", "d1a3wa3.ent\n\n  x/d2.ent more\nd3\n"))
    assert [r.id for r in got.collect()] == ["d1a3wa3", "d2", "d3"]
    cla = text.read_classification(spark, write(tmp_path / "cla.txt", "# c\n\nd1a3wa3 1a3w A:367-500 c.49.1.1 rest\nd2 x y\n"))
    assert [tuple(r) for r in cla.collect()] == [("d1a3wa3", "c.49.1.1")]
    clusters = text.read_cluster_list(spark, write(tmp_path / "c.lst", ">d3wsed_:D\t247\nMKV\n>plain\n"))
    assert [r.id for r in clusters.collect()] == ["d3wsed_", "plain"]


def test_annotations(spark, tmp_path):
    structures_ = spark.createDataFrame([("d1a3wa3", "s/d1a3wa3.ent", "d1a3wa3.jpg", "MKV"), ("short", "s/short.ent", "x.jpg", "M")], "sid string, path string, image string, sequence string")
    cla = spark.createDataFrame([("d1a3wa3", "c.49.1.1")], "sid string, sccs string")
    none = lambda v: spark.createDataFrame([], f"pdb_id string, {v} string")
    rows = joins.annotate(structures_, cla, none("json"), none("body"), none("json"))
    assert len(rows.columns) == 20
    path = str(tmp_path / "a.tsv")
    text.write_annotations(rows, path)
    back = text.read_annotations(spark, path, "SCOPeFold")
    got = {r.SCOPeID: r for r in back.collect()}
    assert got["d1a3wa3"].SCOPeFold == "c.49" and got["d1a3wa3"].PDBSequenceLength == 3 and got["short"].PDBDepositDate is None
    with pytest.raises(ValueError, match="no column nope"):
        text.read_annotations(spark, path, "nope")
    text.write_fasta(rows, str(tmp_path / "f"), "SCOPeID")
    lines = [r.value for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert ">1A3W_A|d1a3wa3|c.49.1.1" in lines and "MKV" in lines


ENT = """HEADER
MODEL        1
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00           N
ATOM      2  CA  ALA A   1      11.639   6.071  -5.147  1.00  0.00           C
HETATM    3  CA AMSE B   2      12.000   6.000  -5.000  0.60  0.00           C
HETATM    4  CA BMSE B   2      13.000   6.000  -5.000  0.40  0.00           C
HETATM    5  O   HOH B   3      13.000   6.000  -5.000  1.00  0.00           O
ENDMDL
MODEL        2
ATOM      1  N   GLY A   1      11.104   6.134  -6.504  1.00  0.00           N
ENDMDL
"""


def test_structures(spark, tmp_path):
    write(tmp_path / "s/deep/d1a3wa3.ent", ENT)
    write(tmp_path / "s/other.txt", ENT)
    atoms = structures.read_structures(spark, str(tmp_path / "s"))
    assert atoms.count() == 5 and {r.structure_id for r in atoms.collect()} == {"d1a3wa3"}
    first = atoms.where("atom_name = 'N'").first()
    assert (first.x, first.res_seq, first.chain, first.record, first.model) == (11.104, 1, "A", "ATOM", 1)
    got = maps.residue_index(filters.strip_solvent(atoms)).orderBy("res_idx").collect()
    assert [(r.aa, r.x) for r in got] == [("A", 11.639), ("M", 12.0)]
    assert {r.chain for r in filters.select_chain(atoms).collect()} == {"A"} and filters.select_chain(atoms, "B").count() == 3


def test_aligners(spark, tmp_path):
    report = "GTalign\n\n     1 e/d1a3wa3.ent Chn:A\n     2 e/d1yl4r1.ent Chn:R\n     3 no id here\n     4 e/d2.ent x\n     9 e/d3.ent\n"
    write(tmp_path / "g/d1a3wa3.ent.out", report)
    write(tmp_path / "g/empty.out", "nothing\n")
    got = results.read_gtalign(spark, str(tmp_path / "g"), 3).orderBy("rank").collect()
    assert [(r.query, r.rank, r.target) for r in got] == [("d1a3wa3", 1, "d1yl4r1"), ("d1a3wa3", 2, ""), ("d1a3wa3", 3, "d2")]
    old = results.gtalign_v1_list(spark, str(tmp_path / "g"), 3).where("query = '1A3W_A'").orderBy("rank").collect()
    assert [r.target for r in old] == ["1A3W_A", "1YL4_R", ""]
    us = write(tmp_path / "us.tsv", "#PDBchain1\tPDBchain2\tTM1\tTM2\nx/d1.ent:A\tx/d2.ent:A\t0.41\t0.37\nx/d1.ent:A\tx/d3.ent:A\t0.41\t0.5\n")
    hits = {(r.query, r.rank): (r.target, r.score) for r in results.read_usalign(spark, us, 5).collect()}
    assert hits["d1", 1] == ("d2", 0.41) and hits["d1", 2] == ("d3", 0.41) and hits["d3", 1] == ("d1", 0.5)
    fs = write(tmp_path / "fs.tsv", "d1a3wa3.ent\td1a7ia2A\t0.52\nd1a3wa3.ent\td1a7ia2A\t0.6\nd1a3wa3.ent\td1a3wa3A\t1.0\nd1a3wa3.ent\td9a7ia2\tbad\n")
    found = results.read_foldseek(spark, fs, 5).orderBy("rank").collect()
    assert [(r.target, r.score) for r in found] == [("d1a7ia2", 0.6), ("d9a7ia2", None)]


def test_lines_of_several_files_in_order(spark, tmp_path):
    """The larger file is read first, the one of the smaller name comes first."""
    write(tmp_path / "fs/a.tsv", "d1\td2\t0.5\n")
    write(tmp_path / "fs/b.tsv", "".join(f"d1\td{n}\t0.5\n" for n in range(3, 40)))
    found = results.read_foldseek(spark, str(tmp_path / "fs"), 50).orderBy("rank").collect()
    assert [r.target for r in found] == [f"d{n}" for n in range(2, 40)]
    head = "#PDBchain1\tPDBchain2\tTM1\tTM2\n"
    write(tmp_path / "us/a.tsv", head + "d1:A\td2:A\t0.4\t0.4\n")
    write(tmp_path / "us/b.tsv", head + "d1:A\td3:A\t0.3\t0.3\nd1:A\td3:A\t0.4\t0.2\nd2:A\td1:A\t0.1\t0.4\n")
    hits = [(r.query, r.target, r.score) for r in results.read_usalign(spark, str(tmp_path / "us"), 5).orderBy("query", "rank").collect()]
    assert hits == [("d1", "d2", 0.4), ("d1", "d3", 0.4), ("d2", "d1", 0.1), ("d3", "d1", 0.2)]


def test_written_files(spark, tmp_path):
    rows = [("deep/a.txt", b"one"), ("b.txt", b""), ("c.txt", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    for folder in (str(tmp_path / "f"), f"file://{tmp_path}/f"):
        assert files.write_files(df, folder) == 3
    assert (tmp_path / "f/deep/a.txt").read_bytes() == b"one" and (tmp_path / "f/c.txt").read_bytes() == b""
    assert sum(p.is_file() for p in (tmp_path / "f").rglob("*")) == 3
    assert files.write_files(df.limit(0), str(tmp_path / "none")) == 0


def test_results(spark, tmp_path):
    hits = spark.createDataFrame([("a", "a", 1.0, 1), ("a", 'b"x', 0.25, 2)], "query string, target string, score double, rank int")
    path = str(tmp_path / "wide")
    queries = spark.createDataFrame([("a",), ("lonely",)], "query string")
    results.write_search_results(hits, path, 3, queries)
    wide = spark.read.csv(path, sep="\t", header=True, quote="")
    assert wide.columns == ["query_image", "0", "1", "2"] and wide.count() == 2
    back = results.read_search_results(spark, path).orderBy("rank").collect()
    assert [(r.query, r.rank, r.target, r.score) for r in back] == [("a", 1, "a", 1.0), ("a", 2, 'b"x', 0.25)]
    results.write_similarity_report(hits.where("rank = 1"), str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).first().value) == {"a": [["a", 1.0]]}
    emb = spark.createDataFrame([("a", "resnet", [1.0, 2.0])], "item_id string, model string, vec array<float>")
    results.write_embeddings(emb, str(tmp_path / "e"))
    assert results.read_embeddings(spark, str(tmp_path / "e"), "resnet").count() == 1
    with pytest.raises(ValueError, match="resnet"):
        results.read_embeddings(spark, str(tmp_path / "e"), "other")


def test_layouts(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", "train" if i < 7 else "eval") for i in range(10)], "id int, label string, split string")
    text.write_labelled_layout(rows, str(tmp_path / "l"))
    assert (tmp_path / "l/split=train/label=a").is_dir()
    text.write_split_lists(rows, str(tmp_path / "s"), 3)
    sizes = {p.parent.name + p.name: sum(len(f.read_text().split()) for f in p.glob("part-*")) for p in (tmp_path / "s").glob("*/*") if p.is_dir()}
    assert sizes == {"split=trainpart=1": 3, "split=trainpart=2": 3, "split=trainpart=3": 1, "split=evalpart=1": 1, "split=evalpart=2": 1, "split=evalpart=3": 1}


def png(path, picture):
    h, w, _ = picture.shape
    block = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in picture)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + block(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + block(b"IDAT", zlib.compress(raw)) + block(b"IEND", b""))


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    pictures = {"d1": rng.integers(0, 256, (3, 3, 3), dtype=np.uint8), "d2": rng.integers(0, 256, (4, 6, 3), dtype=np.uint8)}
    for name, p in pictures.items():
        png(tmp_path / f"{name}.png", p)
    rows = structures.read_images(spark, str(tmp_path))
    assert rows.count() == 2 and filters.filter_min_image(rows, 4).count() == 1
    cells = images.to_pixels(rows.where("path like '%d2%'"))
    assert all((r.r, r.g, r.b) == tuple(pictures["d2"][r.row, r.col]) for r in cells.collect()) and cells.count() == 24
    means = images.image_channel_means(rows).first()
    both = np.concatenate([p.reshape(-1, 3) for p in pictures.values()]).mean(axis=0)
    assert [means.r, means.g, means.b] == pytest.approx(list(both))
    assert {(r.height, r.width, len(r.data)) for r in images.pad_to_size(rows, 8).collect()} == {(8, 8, 192)}
    emb = search.embed(rows, lambda x: x.mean(axis=(2, 3)), "mean", 8)
    got = {r.item_id.rsplit("/", 1)[1]: r.vec for r in emb.collect()}
    want = images.standardize(images.pad_array(pictures["d1"], 8)).mean(axis=(1, 2))
    assert got["d1.png"] == pytest.approx(list(want), rel=1e-5)


def test_fasta_keeps_the_last(spark):
    rows = [(1, "1ABC_A", "d1", "a.1.1.1", "ZZ"), (2, "1ABC_A", "d1", "a.1.1.1", "AA"), (2, "1ABC_A", "d1", "a.1.1.1", "AB"), (3, "2ABC_A", "d2", "a.1.1.1", "MM")]
    df = spark.createDataFrame(rows, "line int, PDBAndChainId string, SCOPeID string, SCOPeFamily string, PDBSequence string")
    of = lambda order: {r.value.split("\n")[0]: r.value.split("\n")[1] for r in text.fasta(df, order).collect()}
    assert of("line") == {">1ABC_A|d1|a.1.1.1": "AB", ">2ABC_A|d2|a.1.1.1": "MM"}


def test_aligner_lines_are_numbers(spark, tmp_path):
    """Sums over lines of many pairs go by hash: a line's place held as names would make each task sort them."""
    head = "#PDBchain1\tPDBchain2\tTM1\tTM2\n"
    write(tmp_path / "us/a.tsv", head + "d1:A\td2:A\t0.4\t0.4\n")
    write(tmp_path / "fs/a.tsv", "d1\td2\t0.5\n")
    for df in (results.read_usalign(spark, str(tmp_path / "us"), 5), results.read_foldseek(spark, str(tmp_path / "fs"), 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_whole_files_as_their_lines(spark):
    atom = lambda n: f"ATOM  {n:5d}  CA  MSE A{n:4d}    {n:8.3f}{1:8.3f}{2:8.3f}  1.00  0.00"
    bodies = ["", "\n", "ENDMDL\n" + atom(1), atom(1) + "\n" + atom(2), f"MODEL 3\r\n{atom(1)}\r\nENDMDL\r\nMODEL 4\r\n{atom(2)}\r\nENDMDL\r\n", f"MODEL        7\n{atom(1)}\n{atom(2)}\nENDMDL", f"MODEL x\n{atom(1)}\nREMARK ENDMDL\n{atom(2)}"]
    files = spark.createDataFrame([(f"a/d{k}.ent", b) for k, b in enumerate(bodies)], "path string, value string")
    lines = spark.createDataFrame([(f"a/d{k}.ent", n, x) for k, b in enumerate(bodies) for n, x in enumerate(b.replace("\r", "").split("\n"))], "path string, line_no long, line string")
    got, want = (sorted(f(x).collect(), key=str) for f, x in ((structures.parse_files, files), (structures.parse_atoms, lines)))
    assert got == want and [(r.structure_id, r.model, r.res_seq) for r in got] == [("d3", 1, 1), ("d3", 1, 2), ("d4", 3, 1), ("d5", 7, 1), ("d5", 7, 2), ("d6", 1, 1), ("d6", 1, 2)]


def test_files_are_written_out_of_their_batch(spark, tmp_path):
    rows = [(f"a/{k}.bin", bytes([k]) * k) for k in range(5)] + [("b/none.bin", None)]
    assert files.write_files(spark.createDataFrame(rows, "path string, content binary").coalesce(1), f"file://{tmp_path}") == 6
    assert {p.relative_to(tmp_path).as_posix(): p.read_bytes() for p in tmp_path.rglob("*.bin")} == {p: c or b"" for p, c in rows}


def test_reports_are_exchanged_as_lists(spark, tmp_path):
    from foldgrid import queries

    spark.createDataFrame([(k % 3, k) for k in range(12)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = queries._reports(spark, str(tmp_path))
    assert {r.path: r.value.split("\n")[2] for r in rows.collect()} == {f"out/d{k:06d}.ent.out": f"{1:6d} {'none' if k == 0 else f'dir/d{k:06d}.ent'} Chn:A" for k in range(3)}
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()


def filtered_png(picture, kind, filters):
    """A PNG file of one filter a row, made by the definitions: what is left, above and above left is taken off."""
    h, w, n = picture.shape
    row, raw = picture.reshape(h, w * n).astype(int), []
    for y in range(h):
        line = []
        for x in range(w * n):
            a, b, c = row[y, x - n] if x >= n else 0, row[y - 1, x] if y else 0, row[y - 1, x - n] if y and x >= n else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((row[y, x] - (0, a, b, (a + b) // 2, near)[filters[y]]) % 256)
        raw.append(bytes([filters[y], *line]))
    block = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    body = zlib.compress(b"".join(raw))
    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + block(b"IDAT", body[:9]) + block(b"IDAT", body[9:]) + block(b"IEND", b"")


def test_packed_pictures_are_those_of_single_files(spark, tmp_path):
    """All kinds of samples and filters, as Spark's reader has them."""
    rng = np.random.default_rng(3)
    bodies = {f"k{kind}.png": filtered_png(rng.integers(0, 256, (7, 5, n), dtype=np.uint8), kind, [0, 1, 2, 3, 4, 3, 1]) for kind, n in ((0, 1), (2, 3), (4, 2), (6, 4))}
    bodies |= {"first.png": filtered_png(rng.integers(0, 256, (2, 3, 3), dtype=np.uint8), 2, [4, 2]), "plain.png": filtered_png(rng.integers(0, 256, (2, 3, 3), dtype=np.uint8), 2, [0, 0])}
    (tmp_path / "one").mkdir()
    for name, body in bodies.items():
        (tmp_path / "one" / name).write_bytes(body)
    packed = lambda rows: files.write_packed(spark.createDataFrame(rows, "path string, content binary").coalesce(1), str(tmp_path / "packs"))
    packed(list(bodies.items())[:4]), packed(list(bodies.items())[4:])
    of = lambda df: {r.path.rsplit("/", 1)[-1]: (*r.image[1:5], bytes(r.image.data)) for r in df.collect()}
    got = structures.read_packed_images(spark, str(tmp_path / "packs"))
    assert of(got) == of(structures.read_images(spark, str(tmp_path / "one"))) and len(of(got)) == 6
    assert len(list((tmp_path / "packs").glob("*.parquet"))) == 2
    packed([("bad.png", b"GIF89a")])
    with pytest.raises(Exception, match="bad.png: neither"):
        structures.read_packed_images(spark, str(tmp_path / "packs")).collect()


def test_packed_structures_are_those_of_single_files(spark, tmp_path):
    write(tmp_path / "s/deep/d1a3wa3.ent", ENT)
    write(tmp_path / "s/d2.ent", ENT.replace("MODEL ", "REMARK"))
    rows = [("deep/d1a3wa3.ent", ENT.encode()), ("d2.ent", ENT.replace("MODEL ", "REMARK").encode()), ("none.ent", None)]
    files.write_packed(spark.createDataFrame(rows, "path string, content binary"), str(tmp_path / "packs"))
    got, want = (sorted(map(str, df.collect())) for df in (structures.read_packed_structures(spark, str(tmp_path / "packs")), structures.read_structures(spark, str(tmp_path / "s"))))
    assert got == want and len(got) == 10


def test_packed_structures_are_exchanged_whole(spark, tmp_path):
    files.write_packed(spark.createDataFrame([(f"d{k}.ent", ENT.encode()) for k in range(3)], "path string, content binary"), str(tmp_path / "packs"))
    rows = maps.residue_index(filters.select_chain(structures.read_packed_structures(spark, str(tmp_path / "packs"))))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.index("Generate")
    assert {(r.structure_id, r.res_idx) for r in rows.collect()} == {(f"d{k}", 0) for k in range(3)}
