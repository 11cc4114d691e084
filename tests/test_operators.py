"""Operators on tiny fixtures with hand-worked answers, array twins and properties."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldgrid.operators import clusters, energies, filters, hits, images, joins, maps, metrics, reports, sampling, search
from foldgrid.operators.common import grouped_rank

LABELS = "id string, class string, fold string, superfamily string, family string"
HITS = "query string, target string, score double, rank int"


def labels_of(spark, classes):
    return spark.createDataFrame([(i, c, f"{c}.1", f"{c}.1.{k % 2}", f"{c}.1.{k % 2}.{k}") for k, (i, c) in enumerate(classes)], LABELS)


def hits_of(spark, query, targets):
    return spark.createDataFrame([(query, t, 1.0 / (k + 1), k + 1) for k, t in enumerate(targets)], HITS)


# --- metrics


def test_precision_by_hand(spark):
    labels = labels_of(spark, [("q", "a"), ("m1", "a"), ("n1", "b"), ("m2", "a"), ("m3", "a"), ("n2", "b"), ("far", "a")])
    got = {r.level: r for r in metrics.query_metrics(hits_of(spark, "q", ["q", "m1", "n1", "m2", "m3", "n2"]), labels, 5).collect()}["class"]
    assert (got.tp, got.valid, got.r) == (3, 5, 4) and got.patk == 0.6 and got.ratk == 0.75
    assert got.apk == pytest.approx((1 + 2 / 3 + 3 / 4) / 4)


def test_unlabelled_targets_take_no_rank(spark):
    labels = labels_of(spark, [("q", "a"), ("m1", "a"), ("m2", "a")])
    got = {r.level: r for r in metrics.query_metrics(hits_of(spark, "q", ["x", "m1", "m2"]), labels, 2).collect()}["class"]
    assert got.patk == 1.0 and got.apk == 1.0
    old = {r.level: r for r in metrics.query_metrics_v1(hits_of(spark, "q", ["q", "x", "m1"]), labels, 3).collect()}["class"]
    assert old.patk == pytest.approx(2 / 3) and old.apk == pytest.approx((1 + 2 / 3) / 2)


def test_nothing_relevant_and_repeated_labels(spark):
    labels = labels_of(spark, [("q", "a"), ("n1", "b"), ("n1", "c"), ("n2", "b")])
    got = {r.level: r for r in metrics.query_metrics(hits_of(spark, "q", ["n1", "n2"]), labels, 5).collect()}["class"]
    assert (got.r, got.patk, got.apk, got.ratk) == (0, 0, 0, 0)
    assert {(r.level, r.value): r.r for r in metrics.relevant_counts(labels).collect()}["class", "b"] == 1
    assert metrics.skipped_queries(hits_of(spark, "u", ["n1"]), metrics.query_metrics(hits_of(spark, "u", ["n1"]), labels, 5)).count() == 1
    v1 = {r.level: r for r in metrics.query_metrics_v1(hits_of(spark, "q", ["n1"]), labels, 5).collect()}["class"]
    assert v1.apk is None and v1.tp == 0


def test_means_comparison_and_triage(spark):
    labels = labels_of(spark, [("q", "a"), ("m", "a"), ("n", "b"), ("o", "b")])
    a, b = (metrics.query_metrics(hits_of(spark, "q", t), labels, 2) for t in (["m", "n"], ["n", "o"]))
    table = metrics.compare_methods({"a": metrics.mean_metrics(a), "b": metrics.mean_metrics(b)}).collect()
    assert {(r["metric"], r["method"]): r["class"] for r in table}["patk", "a"] == 0.5 and len(table) == 6
    assert [r.verdict for r in filters.triage_queries(b, "class").collect()] == ["bad"]
    older = spark.createDataFrame([("a", "fold", 1), ("b", "fold", 2), ("c", "fold", 5), ("d", "family", 5), ("e", "fold", 0)], "query string, level string, tp int")
    assert {(r.query, r.verdict) for r in filters.triage_queries_v1(older, 5).collect()} == {("a", "bad"), ("c", "good")}
    assert metrics.distinct_per_column(labels).first()["class"] == 2 and metrics.distinct_per_column(labels, True).first()["class"] == 2
    assert [r.c for r in metrics.unknown_names(["a", "zz"], labels.select(F.col("class").alias("c")), "c").collect()] == ["zz"]


# --- search


def test_blocks_equal_plain_search(spark):
    rng = np.random.default_rng(0)
    data = [(f"i{k}", "m", [float(x) for x in rng.normal(size=8)]) for k in range(60)] + [("zero", "m", [0.0] * 8)]
    emb = spark.createDataFrame(data, "item_id string, model string, vec array<float>")
    vec = np.array([d[2] for d in data], np.float32).astype(float)
    unit = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-8)
    scores = np.round(unit @ unit.T, 9)
    want = {(data[a][0], data[b][0]): scores[a, b] for a in range(61) for b in range(61)}
    for blocks in (1, 4):
        got = {(r.query, r.target): r.score for r in search.cosine_all_pairs(emb, blocks).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)
        top = {(r.query, r.rank): r.target for r in search.search_all(emb, 3, blocks).collect()}
        assert all(top[f"i{k}", 1] == f"i{k}" for k in range(60)) and len(top) == 183
    assert "i7" not in {r.target for r in search.search_one(emb, emb.where("item_id = 'i7'"), 5).collect()}
    assert search.cosine_blocks(emb, 2, 3, queries=emb.where("item_id = 'i1'")).select("query").distinct().count() == 1


@pytest.mark.parametrize("size", [11, 40, 1000])
def test_pruned_search_equals_plain_search(spark, monkeypatch, size):
    monkeypatch.setattr(search, "ROOT", 0)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    vec = [[float(x) for x in centres[i % 12] + 0.05 * rng.normal(size=6)] for i in range(240)]
    vec[100:150] = [vec[0]] * 50  # one vector many times over
    data = [(f"i{k}", "m", v) for k, v in enumerate(vec)] + [("zero", "m", [0.0] * 6), ("tiny", "m", [1e-9] * 6), ("opposite", "m", [-x for x in vec[0]]), ("none", "m", None)]
    data += [data[3], data[120]]  # repeated rows
    emb = spark.createDataFrame(data, "item_id string, model string, vec array<float>")
    plain = search.top_k(search.cosine_blocks(emb.where("vec IS NOT NULL"), 5, 1), 5)
    key = lambda df: sorted((r.query, r.rank, r.target, round(r.score, 7)) for r in df.collect())
    assert key(search.top_k(search.pruned_hits(emb, 5, size), 5)) == key(plain)
    if size < 1000:
        assert key(search.search_all(emb, 5, one_block=100)) == key(plain)


def test_pruned_search_skips_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ROOT", 0)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    data = [(f"i{k}", "m", [float(x) for x in centres[k % 40] + 0.02 * rng.normal(size=16)]) for k in range(2000)]
    emb = spark.createDataFrame(data, "item_id string, model string, vec array<float>")
    r = search.pruning_report(emb, 5, 50).first()
    assert r.blocks >= 40 and r.compared < 0.3 * r.pairs and r.asked < 0.25 * r.possible
    assert search.pruned_hits(emb.limit(0), 5).collect() == []


def test_ties_go_by_name(spark):
    rows = spark.createDataFrame([("q", "b", 0.5), ("q", "a", 0.5), ("q", "c", 0.9)], "query string, target string, score double")
    assert [r.target for r in search.top_k(rows, 2).orderBy("rank").collect()] == ["c", "a"]


# --- aligner hits


def test_directions_and_cuts(spark):
    pairs = spark.createDataFrame([("a", "b", 0.4, 0.3, 0), ("a", "c", 0.4, 0.2, 1), ("a", "b", 0.1, 0.35, 2)], "a string, b string, tm1 double, tm2 double, line_no long")
    got = {(r.query, r.target): (r.score, r.line_no) for r in hits.both_directions(pairs).collect()}
    assert got["a", "b"] == (0.1, 0) and got["b", "a"] == (0.35, 1) and len(got) == 4
    ties = spark.createDataFrame([("q", "x", 0.5, 2), ("q", "y", 0.5, 1), ("q", "q", 0.9, 0)], "query string, target string, score double, line_no long")
    assert [r.target for r in hits.top_k_aligner(ties, 2, drop_self=True).orderBy("rank").collect()] == ["y", "x"]
    assert [r.target for r in hits.usalign_v1_list(ties.where("target != 'q'"), 2).orderBy("rank").collect()] == ["q", "y"]
    profile = hits.score_profile(spark.createDataFrame([("0",), ("x",), ("2.5",), (None,)], "score string")).first()
    assert (profile.n, profile.least, profile.greatest, profile.zeros) == (2, 0.0, 2.5, 1)


# --- samples


def test_splits_by_hand(spark):
    rows = spark.createDataFrame([(f"{c}{i}", c) for c, n in (("a", 1), ("b", 2), ("c", 5)) for i in range(n)], "id string, label string")
    train = {r.label: r.n for r in sampling.ordered_split(rows, "label").where("split = 'train'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert train == {"b": 1, "c": 4}
    three = spark.createDataFrame([(i, "a") for i in "xyz"], "id string, label string")
    assert sorted(r.split for r in sampling.stratified_split(three, "label", 0.2).collect()) == ["eval", "train", "train"]
    parts = lambda n: sorted(r["count"] for r in sampling.chunk(spark.range(n), 4).groupBy("part").count().collect())
    assert parts(10) == [1, 3, 3, 3] and parts(5) == [1, 2, 2]
    assert sampling.random_split(spark.range(100), 0.3).where("split = 'val'").count() == 30 and sampling.eval_sample(rows, "label").count() == 3


def test_samples_are_stable_and_balanced(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2900, "big").otherwise("small").alias("label"))
    a, b = (sorted(r.id for r in sampling.balanced_sample(rows, rows, "label", 50).collect()) for _ in range(2))
    assert a == b and len(a) == 100
    drawn = sampling.resample_balanced(rows, 2000)
    n = {r.label: r["count"] for r in drawn.groupBy("label").count().collect()}
    assert sum(n.values()) == 2000 and abs(n["big"] - 1000) < 120
    weights = sampling.with_weights(rows).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1) for r in weights)
    summary = {r["class"]: r.total for r in sampling.class_summary(sampling.stratified_split(rows, "label", 0.1)).collect()}
    assert summary == {"ALL": 3000, "big": 2900, "small": 100}
    assert sampling.drop_small_classes(rows, "label", 101).count() == 2900
    assert [r.label_idx for r in sampling.label_index(rows).orderBy("label").collect()] == [0, 1]


def test_grouped_rank(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 50 == 0, None).otherwise(F.lit("g")).alias("g"))
    got = grouped_rank(rows, ["g"], ["id"]).collect()
    for g in (None, "g"):
        mine = sorted((r.id, r._rank, r._n) for r in got if r.g == g)
        assert [r for _, r, _ in mine] == list(range(1, len(mine) + 1)) and {n for *_, n in mine} == {len(mine)}


def test_class_filters(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    assert [r.id for r in filters.exclude_classes(rows, "c", ["b"]).orderBy("id").collect()] == [1, 3]
    items = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sid string")
    cla = spark.createDataFrame([("s1", "l.1.1.1"), ("s2", "a.1.1.1")], "sid string, sccs string")
    assert sorted(r.sid for r in filters.exclude_items_by_class(items, cla, ["l"]).collect()) == ["s2", "s3"]
    split = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "train")], "label string, split string")
    assert sampling.drop_half_empty_labels(split, "label").count() == 2


# --- joins


def test_prefixes(spark):
    files = spark.createDataFrame([("x/d1a3wa3.ent",), ("x/d1b2.ent",)], "path string")
    prefixes = spark.createDataFrame([("d1a3w",), ("d1",), ("zz",)], "prefix string")
    got = joins.match_prefix(files, prefixes)
    assert sorted((r.path, r.prefix) for r in got.collect()) == [("x/d1a3wa3.ent", "d1"), ("x/d1a3wa3.ent", "d1a3w"), ("x/d1b2.ent", "d1")]
    assert [r.prefix for r in joins.unmatched_prefixes(got, prefixes).collect()] == ["zz"]


def test_prefixes_of_many_lengths(spark):
    name = "a" * 300
    files = spark.createDataFrame([(f"x/{name}",), ("x/ab",)], "path string")
    prefixes = spark.createDataFrame([(name[:n],) for n in range(1, 301)] + [("a" * 301,)], "prefix string")
    got = joins.match_prefix(files, prefixes)
    assert sorted((r.path, r.prefix) for r in got.collect()) == sorted([("x/ab", "a")] + [(f"x/{name}", name[:n]) for n in range(1, 301)])
    assert [r.prefix for r in joins.unmatched_prefixes(got, prefixes).collect()] == ["a" * 301]


def test_first_label_and_images(spark):
    annotations = spark.createDataFrame([("d1", "b", 0), ("d1", "a", 1)], "SCOPeID string, fold string, line int")
    pictures = spark.createDataFrame([("p/d1.png",), ("p/d2.png",)], "path string")
    got = {r.SCOPeID: r.label for r in joins.image_labels(pictures, annotations, "fold", "line").collect()}
    assert got == {"d1": "b", "d2": None}
    with pytest.raises(ValueError, match="no image"):
        joins.matched_only(joins.image_labels(pictures.where("path like '%d2%'"), annotations, "fold"))
    found = joins.resolve_assets(spark.createDataFrame([("q", "d1"), ("q", "d9")], "query string, target string"), spark.createDataFrame([("a/d1.jpg",), ("b/d1.png",)], "path string"))
    assert {r.target: r.asset for r in found.collect()} == {"d1": "b/d1.png", "d9": None}


def test_prefixes_equal_plain_ones(spark):
    rnd = np.random.default_rng(2)
    word = lambda: "".join(rnd.choice(list("ab\u00e9"), rnd.integers(0, 6)).tolist())
    paths = [f"{word()}/{word()}" for _ in range(300)] + ["x/aa"] * 40 + [f"{k}/abab" for k in range(60)] + [None, "", "ab"]
    prefixes = sorted({word() for _ in range(60)}) + ["a", "a", None, "abab"]
    got = joins.match_prefix(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(p,) for p in prefixes], "prefix string"))
    want = [(p, q) for p in paths if p is not None for q in {q for q in prefixes if q} if p.split("/")[-1].startswith(q)]
    assert sorted((r.path, r.prefix) for r in got.collect()) == sorted(want)
    empty = joins.match_prefix(spark.createDataFrame([], "path string"), spark.createDataFrame([("a",)], "prefix string"))
    assert empty.collect() == []


# --- maps


def pairs_of(spark, n, values, **channels):
    cells = [(i, j) for i in range(n) for j in range(i + 1, n)]
    rows = [("s", i, j, *[float(channels.get(c, values)[k]) for c in maps.UPPER + maps.LOWER]) for k, (i, j) in enumerate(cells)]
    return spark.createDataFrame(rows, "structure_id string, i int, j int, " + ", ".join(f"{c} double" for c in maps.UPPER + maps.LOWER))


def test_normalize_by_hand(spark):
    got = maps.normalize_maps(pairs_of(spark, 3, [-3, -1, -2])).orderBy("i", "j").collect()
    assert [r.dist for r in got] == [0, 170, 85] and {r.bg_dist for r in got} == {255}
    flat = maps.normalize_maps(pairs_of(spark, 3, [0, 0, 0])).collect()
    assert {r.dist for r in flat} == {0} == {r.bg_dist for r in flat}


def test_assemble_against_arrays(spark):
    rng = np.random.default_rng(1)
    n = 5
    channels = {c: rng.normal(size=10) * 3 - (2 if c in ("es_att", "vdw_att") else 0) for c in maps.UPPER + maps.LOWER}

    def whole(c):
        m = np.zeros((n, n))
        m[np.triu_indices(n, 1)] = channels[c]
        return ((m - m.min()) * (1 / (m.max() - m.min()) * 255)).astype(np.uint8)

    want = np.dstack([whole(c) for c in maps.UPPER]) + np.rot90(np.dstack([whole(c) for c in maps.LOWER]), 2)
    sizes = spark.createDataFrame([("s", n)], "structure_id string, n int")
    pixels = maps.assemble_map(maps.normalize_maps(pairs_of(spark, n, [], **channels)), sizes)
    got = np.zeros((n, n, 3), np.uint8)
    for r in pixels.collect():
        got[r.row, r.col] = (r.r, r.g, r.b)
    assert (got == want).all()
    packed = maps.pack_pixels(pixels).first()
    assert (np.frombuffer(packed.data, np.uint8).reshape(packed.height, packed.width, 3)[:, :, ::-1] == want).all()  # blue first
    turned = maps.rotate(maps.rotate(pixels.withColumn("n", F.lit(n)))).select("row", "col", "r").exceptAll(pixels.select("row", "col", "r"))
    assert turned.isEmpty()


@pytest.mark.parametrize("tile", [2, 3, 64])
def test_tiles_of_odd_maps(spark, monkeypatch, tile):
    """A map with missing pairs, one of a single residue, one without pairs, one of no residue, and two of several tiles."""
    monkeypatch.setattr(maps, "TILE", tile)
    rnd, names = np.random.default_rng(7), maps.UPPER + maps.LOWER
    rows, sizes = [], {"sparse": 7, "one": 1, "bare": 3, "void": 0, "a": 9, "b": 8}
    for s in ("sparse", "a", "b"):
        cells = [(i, j) for i in range(sizes[s]) for j in range(i + 1, sizes[s])]
        for i, j in cells[:: 5 if s == "sparse" else 1]:
            rows.append((s, i, j, *[int(x) for x in rnd.integers(0, 256, 6)], *[10 * k + len(s) for k in range(6)]))
    normalized = spark.createDataFrame(rows, "structure_id string, i int, j int, " + ", ".join(f"{c} int" for c in names) + ", " + ", ".join(f"bg_{c} int" for c in names))
    got = {(r.image_id, r.row, r.col): (r.r, r.g, r.b) for r in maps.assemble_map(normalized, spark.createDataFrame(list(sizes.items()), "structure_id string, n int")).collect()}
    want = {}
    for s, n in sizes.items():
        known = [r for r in rows if r[0] == s]
        square = np.zeros((6, n, n), np.int64) + (np.array([10 * k + len(s) for k in range(6)]) if known else np.zeros(6, np.int64))[:, None, None]
        for _, i, j, *v in known:
            square[:, i, j] = v[:6]
        total = (square[:3] + np.rot90(square[3:], 2, axes=(1, 2))) % 256
        want |= {(s, i, j): tuple(total[:, i, j].tolist()) for i in range(n) for j in range(n)}
    assert got == want


@pytest.mark.parametrize("whole, held", [(512, 8_000_000), (6, 100)])
@pytest.mark.parametrize("kind", ["derive", "energies", "none"])
def test_map_images_equal_pairs_and_tiles(spark, monkeypatch, whole, held, kind):
    """Chains of 1, 5, 6 and 9 residues, with an unknown letter, a missing place and missing energies, whole and by pairs."""
    monkeypatch.setattr(maps, "WHOLE", whole), monkeypatch.setattr(maps, "HELD", held)
    rng, sides = np.random.default_rng(3), {1: 1, 2: 5, 3: 6, 4: 9}
    rows = [(s, i, None if i == 3 else "ARNDCQWFI"[i], *(None if s == 4 and i == 2 else float(x) for x in rng.random(3) * 9)) for s, n in sides.items() for i in range(n)]
    residues = spark.createDataFrame(rows, "structure_id long, res_idx int, aa string, x double, y double, z double")
    cells = [(s, i, j, *map(float, rng.normal(size=4))) for s, n in sides.items() for i in range(n) for j in range(i + 1, n) if s != 3 and (i + j) % 3]
    energies = spark.createDataFrame(cells, "structure_id long, i int, j int, vdw_att double, vdw_rep double, es_att double, es_rep double")
    rules = lambda dist, hydro: {"vdw_att": -dist, "vdw_rep": dist * 2 - 9, "es_att": -hydro, "es_rep": dist - hydro}
    pairs = maps.with_hydrophobicity(maps.residue_pairs(residues))
    if kind == "derive":
        pairs = pairs.withColumns(rules(F.col("dist"), F.col("hydro")))
    elif kind == "energies":
        pairs = pairs.join(energies, ["structure_id", "i", "j"], "left")
    else:
        pairs = pairs.withColumns({c: F.lit(0.0) for c in ("vdw_att", "vdw_rep", "es_att", "es_rep")})
    want = maps.pack_pixels(maps.assemble_map(maps.normalize_maps(pairs), residues.groupBy("structure_id").agg(F.count(F.lit(1)).cast("int").alias("n"))))
    got = maps.map_images(residues, energies if kind == "energies" else None, rules if kind == "derive" else None)
    as_rows = lambda df: {(r.image_id, r.height, r.width, bytes(r.data)) for r in df.collect()}
    assert as_rows(got) == as_rows(want) and got.count() == 4
    assert {tuple(r) for r in images.unpack_pixels(got).collect()} == {tuple(r) for r in images.to_pixels(got.select(F.col("image_id").cast("string").alias("path"), F.struct("height", "width", F.lit(3).alias("nChannels"), "data").alias("image"))).withColumn("image_id", F.col("image_id").cast("long")).collect()}
    pixels, means = images.unpack_pixels(got), spark.createDataFrame([(7.5, 300.0, -4.0)], "r double, g double, b double")
    plain = {(r.image_id, r.feature, r.row, r.col): (r.r, r.g, r.b) for r in images.ablate(pixels, means).collect()}
    for r in images.ablate_images(got, means).collect():
        square = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)[:, :, ::-1]
        assert all(plain.pop((r.image_id, r.feature, i, j)) == tuple(square[i, j]) for i in range(r.height) for j in range(r.width))
    assert not plain


def test_turned_distances_need_no_join(spark):
    rng = np.random.default_rng(5)
    rows = [(s, i, "ARNDCQEGHILK"[i], *map(float, rng.random(3) * 25)) for s, n in (("a", 2), ("b", 9), ("c", 12)) for i in range(n)]
    residues = spark.createDataFrame(rows, "structure_id string, res_idx int, aa string, x double, y double, z double")
    sizes = residues.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"))
    for scale in (lambda x: x, lambda x: maps.normalize_maps_v1(x)):
        as_rows = lambda df: {tuple(r) for r in df.select("image_id", "row", "col", F.round("dist", 9), "hydro", "charge").collect()}
        want = as_rows(maps.assemble_map_v1(scale(maps.contact_maps_v1(residues)), sizes))
        assert as_rows(maps.assemble_map_v1(scale(maps.contact_maps_v1(residues, turned=True)), sizes)) == want and len(want) == 2 + 72 + 132


def test_one_exchange_of_cells(spark):
    channels = {c: np.arange(10.0) for c in maps.UPPER + maps.LOWER}
    normalized = maps.normalize_maps(pairs_of(spark, 5, [], **channels))
    plan = maps.assemble_map(normalized, spark.createDataFrame([("s", 5)], "structure_id string, n int"))._jdf.queryExecution().executedPlan().toString()
    cells = [line for line in plan.split("\n") if "Exchange" in line and "top#" in line]
    assert len(cells) == 1


def test_long_chains_are_many_tasks(spark, monkeypatch):
    n = 1500
    residues = spark.range(n).select(F.lit("s").alias("structure_id"), F.col("id").cast("int").alias("res_idx"), F.lit("A").alias("aa"), *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(500)) / 10.0).alias(c) for c in "xyz"])
    whole = maps.residue_pairs(residues)
    sums = lambda df: df.agg(F.count(F.lit(1)), F.sum("i"), F.sum("j"), F.round(F.sum("dist"), 3)).first()
    want = sums(whole)
    assert want[0] == n * (n - 1) // 2
    monkeypatch.setattr(maps, "PAIRS", 20_000)
    split = maps.residue_pairs(residues)
    assert sums(split) == want and split.select(F.spark_partition_id().alias("p"), "i").groupBy("p").count().count() > 1
    assert "Join" not in split._jdf.queryExecution().executedPlan().toString()


def test_contact_maps_v1_against_arrays(spark):
    rng = np.random.default_rng(2)
    n, letters = 12, "ARNDCQEGHILK"
    xyz = rng.random((n, 3)) * 25
    residues = spark.createDataFrame([("s", i, letters[i], *map(float, xyz[i])) for i in range(n)], "structure_id string, res_idx int, aa string, x double, y double, z double")
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    low = np.tril(d)
    square = low + np.rot90(low, 2)
    positive, negative = set("RHK"), set("DE")
    sizes = spark.createDataFrame([("s", n)], "structure_id string, n int")
    touched = maps.contact_maps_v1(residues, 15.0)
    for r in touched.collect():
        a, b = letters[r.i], letters[r.j]
        near = square[r.i, r.j] < 15 or square[r.j, r.i] < 15
        assert r.charge == float(near and ((a in positive and b in negative) or (a in negative and b in positive)))
    cells = {(r.row, r.col): r.dist for r in maps.assemble_map_v1(touched, sizes).collect()}
    assert len(cells) == n * (n - 1) and all(abs(v - square[k]) < 1e-9 for k, v in cells.items())


def atom_rows(spark, rows):
    schema = "structure_id string, line_no long, record string, atom_name string, altloc string, res_name string, chain string, res_seq int, icode string, x double, y double, z double, occupancy double"
    return spark.createDataFrame(rows, schema)


def test_residues_and_peptides(spark):
    rows, line = [], 0
    for k, (name, gap) in enumerate([("ALA", 0), ("MSE", 0), ("HOH", 0), ("GLY", 50), ("TRP", 0)]):
        for atom, shift in (("N", 0.0), ("CA", 1.0), ("C", 2.0)):
            rows.append(("s", line, "ATOM", atom, "", name, "A", k, "", 3.3 * k + gap + shift, 0.0, 0.0, 1.0))
            line += 1
    rows.append(("s", line, "ATOM", "CA", "B", "ALA", "A", 0, "", 99.0, 0.0, 0.0, 0.2))
    atoms = atom_rows(spark, rows)
    got = maps.residue_index(atoms).orderBy("res_idx").collect()
    assert [r.aa for r in got] == ["A", "M", "G", "W"] and [r.res_idx for r in got] == [0, 1, 2, 3] and got[0].x == 1.0
    assert maps.sequence(maps.residue_index(atoms)).first().sequence == "AMGW"
    # the water leaves no residue; the jump of 50 breaks the chain before G, and after it G stands apart from W
    assert maps.peptide_sequence(atoms, 1.8).first().sequence == "AM"
    assert filters.select_chain(atoms.union(atoms.withColumn("chain", F.lit("B")).withColumn("line_no", F.col("line_no") + 100))).select("chain").distinct().count() == 1


# --- energies


def frame_atoms(spark, seed=0, n=24, solvent=6):
    rng = np.random.default_rng(seed)
    rows = [(f"s{k % 2}", f, "protein" if i < n else rng.choice(["solvent", "ion"]).item(), int(i // 4), i, *map(float, rng.random(3) * 1.2), float(rng.normal()), 0.3, 0.4) for k in range(2) for f in range(2) for i in range(n + solvent)]
    schema = "structure_id string, frame int, kind string, res_idx int, atom_idx int, x double, y double, z double, q double, sigma double, epsilon double"
    return spark.createDataFrame(rows, schema)


def test_frame_energies_equal_joins(spark):
    atoms = frame_atoms(spark)
    joined = energies.subtract_solvent(energies.residue_pair_energy(energies.atom_pair_energies(atoms), atoms), energies.residue_solvent_energies(atoms))
    key = lambda r: (r.structure_id, r.frame, r.i, r.j)
    a, b = ({key(r): r for r in df.collect()} for df in (joined, energies.frame_energies(atoms)))
    assert a.keys() == b.keys() and len(a) == 4 * 15
    for k in a:
        for t in energies.TERMS:
            assert a[k][t] == pytest.approx(b[k][t], rel=1e-9, abs=1e-9)
    mean = energies.frame_average(energies.frame_energies(atoms), energies.frame_counts(atoms)).where("i = 0 AND j = 1 AND structure_id = 's0'").first()
    assert mean.vdw_att == pytest.approx((b["s0", 0, 0, 1].vdw_att + b["s0", 1, 0, 1].vdw_att) / 2)


def test_frames_that_lie_together_are_exchanged_once(spark):
    atoms = frame_atoms(spark).drop("atom_idx")
    twice = atoms.repartition("structure_id").withColumn("frame", F.explode(F.array("frame", F.col("frame") + 2)))
    values = energies.frame_energies(twice)
    assert values._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    key = lambda r: (r.structure_id, r.i, r.j)
    plain = {(*key(r), r.frame): r[4:] for r in energies.frame_energies(atoms).collect()}
    assert {(*key(r), r.frame): r[4:] for r in values.collect()} == plain | {(*k[:3], k[3] + 2): v for k, v in plain.items()}
    mean = energies.frame_average(values, energies.frame_counts(twice))
    assert "SortMergeJoin" not in mean._jdf.queryExecution().executedPlan().toString()
    want = {key(r): r[3:] for r in energies.frame_average(energies.frame_energies(atoms), energies.frame_counts(atoms)).collect()}
    got = {key(r): r[3:] for r in mean.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_sums_do_not_depend_on_stretches_or_order(spark, monkeypatch):
    atoms = frame_atoms(spark, 7)
    rows = lambda: {tuple(r) for r in energies.frame_energies(atoms.orderBy(F.rand())).collect()}
    want = rows()
    assert len(want) == 4 * 15 and rows() == want
    renumbered = atoms.withColumn("atom_idx", -F.col("atom_idx"))
    assert {tuple(r) for r in energies.frame_energies(renumbered).collect()} == want
    monkeypatch.setattr(energies, "CELLS", 7)
    got = {tuple(r[:4]): r[4:] for r in map(tuple, rows())}
    assert got.keys() == {r[:4] for r in want} and all(got[r[:4]] == pytest.approx(r[4:], rel=1e-9, abs=1e-9) for r in want)


@pytest.mark.parametrize("crowd", [4, 11, 25])
def test_large_frames_are_split(spark, monkeypatch, crowd):
    monkeypatch.setattr(energies, "CROWD", crowd)
    monkeypatch.setattr(energies, "CELLS", 40)
    atoms = frame_atoms(spark, 3).union(frame_atoms(spark, 4, 9, 2).withColumn("structure_id", F.lit("small"))).union(frame_atoms(spark, 5, 0, 3).withColumn("structure_id", F.lit("wet")))
    for subtract in (True, False):
        key = lambda r: (r.structure_id, r.frame, r.i, r.j)
        pairs = energies.residue_pair_energy(energies.atom_pair_energies(atoms), atoms)
        plain = energies.subtract_solvent(pairs, energies.residue_solvent_energies(atoms)) if subtract else pairs
        a, b = ({key(r): r for r in df.collect()} for df in (plain, energies.frame_energies(atoms, subtract)))
        assert a.keys() == b.keys() and len(a) > 60
        assert all(a[k][t] == pytest.approx(b[k][t], rel=1e-9, abs=1e-9) for k in a for t in energies.TERMS)


def test_frame_of_thirty_thousand_atoms(spark):
    n = 30_000
    rows = spark.range(n).select(
        F.lit("s").alias("structure_id"), F.lit(0).alias("frame"), F.when(F.col("id") < 40, "protein").otherwise("solvent").alias("kind"), F.expr("int(id div 10)").alias("res_idx"), F.col("id").cast("int").alias("atom_idx"),
        *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 100.0).alias(k) for k in "xyz"], F.lit(0.1).alias("q"), F.lit(0.3).alias("sigma"), F.lit(0.4).alias("epsilon"),
    )
    got = {(r.i, r.j): r for r in energies.frame_energies(rows).collect()}
    pairs = energies.residue_pair_energy(energies.atom_pair_energies(rows), rows)
    want = {(r.i, r.j): r for r in energies.subtract_solvent(pairs, energies.residue_solvent_energies(rows)).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    assert all(got[k][t] == pytest.approx(want[k][t], rel=1e-7, abs=1e-9) for k in got for t in energies.TERMS)


def test_energy_log(spark):
    log = lambda stage, values: [("r", stage, k + 1, 0.5 * (k + 1), float(e), 10) for k, e in enumerate(values)]
    data = log("npt", [-100, 50, -100, -50]) + log("nvt", [-100, -10]) + log("production", [-100.0] * 9 + [-10.0] + [-600.0])
    rows = spark.createDataFrame(data, "run_id string, stage string, step int, time_ps double, energy_kj double, n_atoms int")
    got = {(r.stage, r.step): r for r in energies.energy_checks(rows).collect()}
    assert got["npt", 2].positive and not got["npt", 2].rise and got["npt", 4].rise and not got["nvt", 2].rise
    assert ("production", 1) not in got and got["production", 10].rise and len(got) == 7
    stats = {r.stage: r for r in energies.energy_stats(rows).collect()}
    assert stats["npt"].initial == -100 and stats["npt"].final == -50 and stats["npt"].unsteady and stats["npt"].std == pytest.approx(np.std([-100, 50, -100, -50]))
    line = {(r.stage, r.step): r.total_ps for r in energies.stage_timeline(rows, ["npt", "nvt", "production"]).collect()}
    assert line["npt", 1] == 0.5 and line["nvt", 1] == 2.5 and line["production", 1] == 3.5
    assert energies.npt_trend(rows).first().rose and not filters.finite_positions(spark.createDataFrame([("s", 0, float("nan"), 0.0, 0.0)], "structure_id string, frame int, x double, y double, z double")).first().finite


# --- reports


def test_report_and_auc(spark):
    rng = np.random.default_rng(0)
    data = [(i, int(rng.integers(0, 3)), [round(float(x), 1) for x in rng.random(3)]) for i in range(80)]
    rows = spark.createDataFrame(data, "id int, label int, probs array<double>")
    got = {r["class"]: r for r in reports.classification_report(rows).collect()}
    pred = [int(np.argmax(p)) for *_, p in data]
    for c in range(3):
        tp = sum(p == c == l for p, (_, l, _) in zip(pred, data))
        assert got[str(c)].recall == pytest.approx(tp / sum(l == c for _, l, _ in data)) and got[str(c)].precision == pytest.approx(tp / pred.count(c))
    assert got["accuracy"].recall == pytest.approx(np.mean([p == l for p, (_, l, _) in zip(pred, data)]))
    for r in reports.auc_ovr(rows).collect():
        pos, neg = ([p[r["class"]] for _, l, p in data if (l == r["class"]) == side] for side in (True, False))
        assert r.auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


def test_auc_of_odd_scores(spark):
    """Ties of a third of all rows, negative, tiny and huge scores, nulls and NaN, a class without rows of its own."""
    rnd = np.random.default_rng(5)
    pool = [0.0, -0.0, 1e-30, -1e-30, 1e300, -1e300, float("inf"), float("-inf"), 0.25, 0.25, 0.25, -0.7, None, float("nan")]
    data = [(i, int(rnd.integers(0, 3)), [pool[rnd.integers(0, len(pool))] if i % 3 else 0.25 for _ in range(4)]) for i in range(150)]
    order = lambda x: (0, 0.0) if x is None else (2, 0.0) if x != x else (1, x)
    got = {r["class"]: r for r in reports.auc_ovr(spark.createDataFrame(data, "id int, label int, probs array<double>")).collect()}
    for c in range(3):
        pos, neg = ([order(p[c]) for _, l, p in data if (l == c) == side] for side in (True, False))
        assert got[c].auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])) and got[c].support == len(pos)
    assert got[3].auc is None


def brute_clusters(data, k, seed, steps, scale=1024):
    """The rules of clusters.cluster, item by item."""
    def md5(i, r):
        return hashlib.md5(f"{i}|{r}|{seed}".encode()).hexdigest()

    def d2(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    items = [(i, tuple(math.floor(x * scale) for x in v)) for i, v in data]
    centres = [min(items, key=lambda t: (md5(t[0], 0), t[0]))[1]]
    for r in (1, 2):
        far = [(min(d2(v, c) for c in centres), i, v) for i, v in items]
        drawn = sorted((-math.log((int(md5(i, r)[:13], 16) + 1) / 2**52) / d, i, v) for d, i, v in far if d)
        centres += [v for _, _, v in drawn[: 2 * k]]
    near = lambda v, cs: min(range(len(cs)), key=lambda n: (d2(v, cs[n]), n))
    weight = Counter(near(v, centres) for _, v in items)
    kept = [max(range(len(centres)), key=lambda n: (weight[n], -n))]
    while len(kept) < k:
        worth = [weight[n] * min(d2(c, centres[j]) for j in kept) for n, c in enumerate(centres)]
        if not max(worth):
            break
        kept.append(worth.index(max(worth)))
    centres = [centres[n] for n in kept]
    for _ in range(steps):
        place = [near(v, centres) for _, v in items]
        for n in range(len(centres)):
            if mine := [v for (_, v), p in zip(items, place) if p == n]:
                centres[n] = tuple(sum(x) // len(mine) for x in zip(*mine))
    return Counter((i, near(v, centres)) for i, v in items), centres


CLUSTERED = "item_id string, vec array<float>"


def test_clusters(spark):
    rng = np.random.default_rng(1)
    data = [(str(i), [float(np.float32(x)) for x in rng.normal(size=3) * 0.3 + 5 * (i % 4)]) for i in range(120)] + [("7", [1.0, 2.0, 3.0])] * 3
    want, centres = brute_clusters(data, 4, 42, 6)
    for parts in (1, 5):
        assigned, got = clusters.cluster(spark.createDataFrame(data, CLUSTERED).repartition(parts), 4, steps=6)
        assert Counter((r.item_id, r.cluster) for r in assigned.collect()) == want
        assert {r.cluster: r.centre for r in got.collect()} == {n: [x / 1024 for x in c] for n, c in enumerate(centres)}
    groups = {r.item_id: r.cluster for r in assigned.where("item_id != '7'").collect()}
    assert [len({groups[str(i)] for i in range(a, 120, 4) if i != 7}) for a in range(4)] == [1] * 4 and len(set(groups.values())) == 4
    assert sum(r.n for r in clusters.cluster_sizes(assigned).collect()) == 123 and clusters.first_of_clusters(assigned, 3).count() == 12


def test_clusters_of_odd_tables(spark):
    none = spark.createDataFrame([("a", None), ("b", []), ("c", [1.0, None]), ("d", [float("nan"), 1.0]), ("e", [float("inf"), 1.0])], CLUSTERED)
    assigned, centres = clusters.cluster(none, 3)
    assert assigned.count() == centres.count() == 0 and assigned.columns == ["item_id", "cluster"]
    same = spark.createDataFrame([("a", [1.0, 2.0])] * 3 + [(None, [1.0, 2.0]), ("b", [9.0, 9.0])], CLUSTERED)
    assigned, centres = clusters.cluster(same, 3)
    assert centres.count() == 2 and Counter(r.cluster for r in assigned.collect()) == {0: 4, 1: 1}
    with pytest.raises(Exception, match="other lengths"):
        clusters.cluster(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], CLUSTERED), 1)
    with pytest.raises(ValueError, match="too large"):
        clusters.cluster(spark.createDataFrame([("a", [1e9])], CLUSTERED), 1)


# --- images


def test_padding():
    small, big = np.arange(27, dtype=np.uint8).reshape(3, 3, 3), np.arange(75, dtype=np.uint8).reshape(5, 5, 3)
    out = images.pad_array(small, 6)
    assert (out[1:4, 1:4] == small).all() and out[0, 0, 0] == 128 and out.shape == (6, 6, 3)
    assert (images.pad_array(big, 4) == big[:4, :4]).all()


def test_ablation(spark):
    rng = np.random.default_rng(3)
    square = [("s", i, j, *map(int, rng.integers(0, 256, 3))) for i in range(4) for j in range(4)]
    pixels = spark.createDataFrame([*square, *(("wide", 0, j, 1, 2, 3) for j in range(3))], "image_id string, row int, col int, r int, g int, b int")
    means = spark.createDataFrame([(0.5, 1.5, 300.0)], "r double, g double, b double")
    got = images.ablate(pixels, means).collect()
    assert len(got) == 6 * 16 and {r.image_id for r in got} == {"s"}
    value = {(i, j): (r, g, b) for _, i, j, r, g, b in square}
    for r in got:
        if r.feature == "vdw_attractive":
            assert (r.r, r.g, r.b) == (value[r.row, r.col][0] if r.col > r.row else 0, 2, 255)
    exact = images.channel_means(pixels).first()
    assert exact.g == pytest.approx((sum(x[4] for x in square) + 6) / 19)


def test_single_rows(spark):
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "item_id string, vec array<double>")
    assert search.cosine_query(emb, emb.where("item_id = 'a'")).count() == 2 and search.cosine_query(emb, emb.limit(0)).count() == 0
    with pytest.raises(Exception, match="one row expected"):
        search.cosine_query(emb, emb).collect()
    pixels = spark.createDataFrame([("p", 0, 0, 1, 2, 3)], "image_id string, row int, col int, r int, g int, b int")
    with pytest.raises(Exception, match="one row expected"):
        images.ablate(pixels, spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 2.0, 2.0)], "r double, g double, b double")).collect()


def test_pictures_are_blue_first(spark):
    pixels = spark.createDataFrame([("p", r, c, r, 10 + c, 200) for r in range(2) for c in range(3)], "image_id string, row int, col int, r int, g int, b int")
    picture = maps.pack_pixels(pixels).first()
    assert (picture.height, picture.width) == (2, 3) and bytes(picture.data) == bytes(x for r in range(2) for c in range(3) for x in (200, 10 + c, r))
    whole = maps.pack_pixels(pixels).selectExpr("image_id AS path", "struct(height, width, 3 AS nChannels, data) AS image")
    back = {tuple(x) for x in images.to_pixels(whole).collect()}
    assert back == {tuple(x) for x in pixels.collect()}


def test_energies_exchange_atoms_alone(spark):
    schema = "structure_id long, frame int, kind string, res_idx int, atom_idx int, x double, y double, z double, q double, sigma double, epsilon double"
    atoms = spark.createDataFrame([(1, 0, "protein", k // 2, k, k / 5, 0.0, 0.0, 0.1, 0.3, 0.2) for k in range(6)], schema)
    pairs = energies.residue_pair_energy(energies.atom_pair_energies(atoms, sizes=True), atoms)
    plain = energies.residue_pair_energy(energies.atom_pair_energies(atoms), atoms)
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in plain.collect()} and pairs.count() == 3
    # of new frames, as the plan of one that ran holds it twice
    exchanges = lambda df: df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    solvent = energies.residue_solvent_energies(atoms)  # none: each residue has 0
    assert {(r.vdw_solv, r.es_solv) for r in solvent.collect()} == {(0.0, 0.0)}
    assert [exchanges(df) for df in (energies.atom_pair_energies(atoms), pairs, solvent, energies.subtract_solvent(pairs, solvent))] == [1, 1, 1, 2]


def test_atom_pairs_of_arrays_equal_those_of_rows(spark, monkeypatch):
    odd = [(None, 0.0, 0.1), (0.1, None, 0.1), (0.1, 0.3, float("nan")), (float("nan"), 0.3, None), (0.0, 0.3, 0.4), (-0.0, 0.3, 0.4), (0.2, 0.3, -0.4)]
    place = [(1.0, 0.0), (1.05, 0.0), (1.2, 3.0), (None, 0.0), (float("nan"), 0.0), (0.0, 0.7), (1.0, 0.9)]
    rows = [("u", 0, "protein", k // 2 if k < 12 else None, k, place[k % 7][0], place[k % 7][1], 0.0, *odd[k % 7]) for k in range(14)]
    atoms = frame_atoms(spark, 2).union(spark.createDataFrame(rows, frame_atoms(spark).schema)).union(frame_atoms(spark).limit(1).withColumn("structure_id", F.lit("alone")))
    of = lambda df: sorted(str(tuple(r)) for r in df.drop("n_i", "n_j").collect())
    want = of(energies.atom_pair_energies(atoms, sizes=True))
    assert of(energies.atom_pair_energies(atoms)) == want and len([r for r in want if "'u'" in r]) > 20 and any("None" in r for r in want) and any("nan" in r for r in want)
    monkeypatch.setattr(energies, "CELLS", 5)
    assert of(energies.atom_pair_energies(atoms)) == want
    assert energies.atom_pair_energies(atoms.limit(0)).collect() == []
