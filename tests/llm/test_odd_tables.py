"""The pipeline and decontamination on odd tables: empty ones, null ids, repeated rows, very long texts, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from foldgrid.llm import decontaminate

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n, vocabulary=20_000):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def pieces():
    rnd = random.Random(31)
    return prose(rnd, 25), [". ".join(prose(rnd, 14).capitalize() for _ in range(6)) + "." for _ in range(60)], prose(rnd, 40_000)


def written(spark, folder, rows, item, more=()):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    docs.select("*", *[F.lit(f"clash {c}").alias(c) for c in more]).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(None, None), (0, item), (0, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def test_pipeline_on_an_empty_table(spark, tmp_path, pieces):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, written(spark, tmp_path, [], pieces[0]))
    assert got.count() == 0 and got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"]


def test_pipeline_on_null_ids_repeated_rows_and_clashing_columns(spark, tmp_path, pieces):
    """A row of each text stays; rows without id or source are rows like others; input columns named as added ones give way."""
    import corpus_pipeline

    item, clean, long = pieces
    rows = [(None if i < 20 else i, t, None if i % 5 == 0 else "s") for i, t in enumerate(clean)]
    rows += [rows[0], rows[30], (None, None, None), (99, None, "s"), (98, "", "s"), (97, f"{clean[0]} {item}.", "s"), (96, long, "t")]
    sf_dir = written(spark, tmp_path, rows, item, ["size", "taken", "place", "row", "draw"])
    docs, left = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir))
        left.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "taken", "place", "row", "draw"]
    assert left[0] == 64  # without the texts that are null or empty
    texts = [r.text for r in docs.select("text").collect()]
    assert len(texts) == len(set(texts)) and not any(item in t for t in texts) and set(texts) <= {*clean, long}
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "place", "row", "draw", "size", "source_size", "target", "taken"]
    assert all(r.taken in (r.size, 2 * r.size) for r in docs.select(F.col("size").cast("long"), F.col("taken").cast("long")).collect())


def test_decontamination_of_odd_rows(spark, pieces):
    """Null ids, repeated rows and a very long text with an item at its end are sought through like others."""
    item, clean, long = pieces
    hit = f"{long} {item}"
    rows = [(None, hit, "a"), (7, hit, "b"), (7, hit, "b"), (8, clean[0], "c"), (None, None, "d"), (9, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").withColumn("row", F.lit(1))
    bench = spark.createDataFrame([(None, None), (5, item), (5, item)], "item_id long, text string")
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(8, clean[0]), (0, ""), (9, "")])
