"""Vector codes, periodic runs and toxicity against brute force, planted cases and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldgrid.llm import codes, queries, runs, toxicity

# --- vector codes

EMB = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(code, error) by row, and the codebooks, by loops over Python integers."""
    vectors = [[int(np.floor(1024 * np.float64(np.float32(c)))) for c in v] for _, v, _ in rows]
    width = len(vectors[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, vectors[i]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    best = lambda x, book: min((far(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in cut:
                own.setdefault(best(v[p], books[p])[1], []).append(v[p])
            for k, vs in own.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    out = []
    for v in cut:
        got = [best(v[p], books[p]) for p in range(parts)]
        out.append(([k for _, k in got], sum(d for d, _ in got)))
    return out, books


def random_vectors(n, size=8, seed=2):
    rnd = np.random.default_rng(seed)
    return [(i, [float(x) for x in rnd.normal(0, 0.05, size)], int(i % 3)) for i in range(n)]


@pytest.mark.parametrize("entries", [4, 16])
def test_codes_equal_plain_ones(spark, entries):
    rows = random_vectors(900)
    rows[100:300] = [(i, rows[7][1], None) for i in range(100, 300)]  # one very common vector, null labels
    rows += [(5, rows[1][1], 1), (None, rows[2][1], 1), (5, rows[5][1], 1)]  # repeated and null ids
    want, books = plain_codes(rows, entries=entries)
    bad = [(-1, None, 0), (-2, [0.1] * 7 + [None], 0), (-3, [float("nan")] * 8, 0), (-4, [float("inf")] + [0.0] * 7, 0), (-5, [], 0), (2000, [0.1] * 9, 0)]
    frame = spark.createDataFrame(rows + bad, EMB).withColumn("rid", F.lit(1)).withColumn("codes", F.lit("clash"))
    coded, got = codes.compress(frame, entries=entries)
    assert got.tolist() == books
    have = sorted((r.id is None, r.id or 0, r.codes, r.error, -1 if r.label is None else r.label) for r in coded.collect())
    assert have == sorted((r[0] is None, r[0] or 0, c, e, -1 if r[2] is None else r[2]) for r, (c, e) in zip(rows, want))
    sums = {}
    for r, (_, e) in zip(rows, want):
        sums[r[2]] = sums.get(r[2], 0) + e
    assert {r.label: r.label_error for r in codes.with_label_error(coded).collect()} == sums


def test_codes_of_odd_tables(spark):
    empty = codes.compress(spark.createDataFrame([], EMB))[0]
    assert codes.with_label_error(empty).collect() == []
    few = codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [-1.5, 2.0, 3e38], 1)], EMB))
    assert sorted((r.id, r.codes, r.error) for r in few[0].collect()) == [(1, [0, 0, 0, 0], 0), (2, [1, 0, 1, 0], 0)]


def test_shortlists_keep_all_nearest():
    rnd = np.random.default_rng(0)
    for scale in (3, 1000, 1 << 40):
        entries = rnd.integers(-scale, scale, (32, 5))
        rows = rnd.integers(-scale, scale, (1, 5)) // 2 + rnd.integers(-scale, scale, (40, 5)) // 8
        listed = codes.shortlist(rows.min(axis=0), rows.max(axis=0), entries)
        exact = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), k) for k, e in enumerate(entries)) for r in rows]
        at, d = codes.nearest(rows, entries[listed])
        assert listed[at].tolist() == [k for _, k in exact]
        assert d.tolist() == [min(x, (1 << 63) - 1) for x, _ in exact]


def test_hilbert_neighbours_are_one_step_apart():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)]) * 8191
    key = codes.hilbert_keys(grid * 9 // 8, np.zeros(3, np.int64), np.full(3, 65535))
    assert len(set(key.tolist())) == side**3
    steps = np.abs(np.diff(grid[np.argsort(key)] // 8191, axis=0)).sum(axis=1)
    assert (steps == 1).all()


# --- periodic runs


def plain_runs(words, least=24, times=3):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def odd_words(rnd):
    k, n, t = rnd.choice([1, 2, 3, 5, 50]), rnd.randrange(0, 150), []
    while len(t) < n:
        u = [rnd.randrange(k) for _ in range(rnd.randrange(1, 12))]
        t += u if rnd.random() < 0.4 else (u * 60)[: rnd.randrange(1, 70)]
        if rnd.random() < 0.2:
            t += t[-rnd.randrange(1, len(t) + 1) :]
    return [f"w{x}" for x in t]


@pytest.mark.parametrize("hashed", [True, False])
def test_runs_equal_plain_ones(hashed):
    rnd = random.Random(6)
    for _ in range(250):
        texts = [[w.encode() for w in odd_words(rnd)] for _ in range(rnd.randrange(1, 5))]
        least, times = rnd.choice([(24, 3), (24, 3), (2, 2), (8, 2), (10, 4)])
        ids, starts = runs._word_ids(texts)
        a, b, q = runs.find_runs(ids, starts, least, times, hashed)
        want = [(int(s) + x, n, p) for s, t in zip(starts, texts) for x, n, p in plain_runs(t, least, times)]
        assert sorted(zip(a.tolist(), (b - a).tolist(), q.tolist())) == want


def test_false_hashes_are_noticed(monkeypatch):
    monkeypatch.setattr(runs, "mix", lambda x: np.zeros_like(x))
    ids, starts = runs._word_ids([[b"x", b"y", b"z"] * 12 + [b"%d" % i for i in range(40)]])
    a, b, q = runs.find_runs(ids, starts)
    assert (a.tolist(), b.tolist(), q.tolist()) == ([0], [36], [3])


def test_runs_of_very_long_texts():
    rnd = random.Random(1)
    passage = [b"%d" % rnd.randrange(10**6) for _ in range(40_000)]
    for words, want in (([b"a"] * 300_000, (0, 300_000, 1)), (passage[:900] * 100, (0, 90_000, 900)), (passage * 2, None), ([b"x", *passage * 3], (1, 120_001, 40_000))):
        ids, starts = runs._word_ids([words])
        got = list(zip(*[x.tolist() for x in runs.find_runs(ids, starts)]))
        assert got == ([want] if want else [])


def test_grammar_derives_its_texts():
    rnd = random.Random(9)
    texts = [[w.encode() for w in odd_words(rnd)] for _ in range(30)]
    ids, starts = runs._word_ids(texts)
    g = runs.Grammar(ids, starts)

    def derive(s):
        return [s] if s < g.base else derive(g.left[s - g.base]) + derive(g.right[s - g.base])

    at = np.flatnonzero(g.alive)
    assert [w for k in at for w in derive(g.symbol[k])] == ids.tolist()
    for lo, hi in zip(starts, starts[1:]):  # no pair is left that occurs twice without overlap
        own, last = {}, g.symbol[lo:hi][g.alive[lo:hi]].tolist()
        for i, pair in enumerate(zip(last, last[1:])):
            assert pair not in own or own[pair] == i - 1
            own.setdefault(pair, i)


def test_run_query_equals_plain(spark, tmp_path):
    rnd = random.Random(3)
    texts = [" ".join(odd_words(rnd)) for _ in range(150)] + [None, "", " \n\t", "one", "x\x1cy \x85z\xa0q", "\x0ba\x0bb " * 30, "long " * 20_000]
    ids = [*range(10, 10 + len(texts))]
    rows = list(zip(ids, texts)) + [(None, texts[0]), (10, texts[0]), (10, texts[1])]
    spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], "doc_id long, text string, collapsed string, runs string, n_words long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()], key=str)
    want, planted = [], 0
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)], planted + 1
        found = plain_runs(words) if n < 5000 else [(0, n, 1)]
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for k, w in enumerate(words) if k not in gone))))
    assert got == sorted(want, key=str) and planted > 5
    assert runs.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- toxicity

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, toxic int"
BAD = ["idiot", "worthless", "scoundrel", "disgusting"]


def misspelt(w, rnd):
    k = rnd.randrange(1, len(w) - 1)
    return rnd.choice([w[:k] + w[k] + w[k:], w + "s", w[:k] + "-" + w[k:], w.upper()])


def planted_texts(n, seed, spell=lambda w, _: w):
    rnd, out = random.Random(seed), []
    for i in range(n):
        words = [f"{rnd.choice('bcdfglmnprst')}{rnd.choice('aeiou')}{rnd.choice('bcdfglmnprst')}{rnd.choice(['en', 'er', 'a', 'o'])}" for _ in range(rnd.randrange(5, 120))]
        if i % 3 == 0:
            words.insert(rnd.randrange(len(words)), spell(rnd.choice(BAD), rnd))
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


def test_unseen_misspellings_are_found(spark):
    known, new = planted_texts(500, 1), planted_texts(150, 2, misspelt)
    texts = known + new
    docs = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(known)], LABELS)
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(texts) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())
    unseen = [i for i in got if i >= len(known) or got[i].held_out]
    right = sum(got[i].predicted == texts[i][1] for i in unseen) / len(unseen)
    assert right >= 0.95


def test_held_out_labels_and_other_columns_are_no_inputs(spark):
    texts = planted_texts(120, 5)
    docs = [(i, t, "en") for i, (t, _) in enumerate(texts)]
    first = [(i, y) for i, (_, y) in enumerate(texts)]
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in first]
    scores = lambda d, y: {r.doc_id: r.score for r in toxicity.score(d, spark.createDataFrame(y, LABELS)).collect()}
    a = scores(spark.createDataFrame(docs, DOCS), first)
    b = scores(spark.createDataFrame(docs, DOCS).withColumn("lang", F.lit("xx")).withColumn("score", F.lit(1)).withColumn("toxic", F.lit(1)), other)
    assert a == b


def test_toxicity_of_odd_tables(spark):
    odd = [(None, "idiot", "en"), (1, None, "en"), (2, "", "en"), (3, " \n#!", "en"), (4, "word " * 300_000 + "idiot", "en"), (5, "idiot", "en"), (5, "idiot", "en")]
    docs = spark.createDataFrame(odd, DOCS)
    none = toxicity.score(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == 7 and {r.score for r in none} == {0.5}
    assert toxicity.score(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
    texts = planted_texts(200, 8)
    both = docs.union(spark.createDataFrame([(100 + i, t, "en") for i, (t, _) in enumerate(texts)], DOCS))
    labels = [(100 + i, y) for i, (_, y) in enumerate(texts)] + [(None, 1), (2, 1), (2, 0), (3, None), (4, 7), (100, 1), (100, 1)]
    got = [r for r in toxicity.score(both, spark.createDataFrame(labels, LABELS)).collect() if r.doc_id is None or r.doc_id < 100]
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.predicted)
    assert by == {None: [1], 1: [0], 2: [0], 3: [0], 4: [1], 5: [1, 1]}


def test_worst_windows_equal_plain():
    rnd = np.random.default_rng(4)
    for _ in range(100):
        sizes = rnd.integers(0, 9, 6)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        value = rnd.normal(size=starts[-1])
        lo, hi, best = toxicity.worst_windows(value, starts, 3)
        for k, n in enumerate(sizes):
            own = value[starts[k] : starts[k + 1]]
            want = max((own[i : i + 3].mean() for i in range(max(1, n - 2))), default=0.0) if n else 0.0
            assert best[k] == pytest.approx(want) and (not n or value[lo[k] : hi[k]].mean() == pytest.approx(want))
