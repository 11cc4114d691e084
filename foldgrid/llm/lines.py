"""Deletion of runs of lines that repeat an earlier run, by winnowing over line hashes. DataFrame functions only.

A run is `min_lines` or more consecutive lines, or one line of `min_words` words or more. Of every window of `min_lines`
line hashes the smallest (the last of equal ones) is a fingerprint, so equal runs share one at the same place; a line that
is the smallest of several windows is one position. Only positions leave the texts, with the lines up to `min_lines` - 1
before and after. Those whose fingerprint occurs once go no further; the others are joined to their fingerprint and
extended to both sides, by comparing lines, to the windows that they stand for. The first place of each window stays;
later places that overlap or follow one another in a document make one maximal run, which is deleted.

Earlier means a smaller doc_id (nulls last), then a smaller hash of the text, then a smaller line number; a run may
repeat one of its own document. Lines without a word are passed over when runs are compared, stay when they stand
outside of deleted runs and go when inside. Null and empty texts have no lines to delete and stay as they are. Rows
with equal doc_id and text are one document to this operator: none of them counts as earlier than another, and all
get the same text. An empty table gives an empty result. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialize


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _kept(text: Column, min_words: int) -> Column:
    """array<struct<at, h, long>>: place and hash of every line that has a word, and whether it is a run of its own."""
    shortest = 2 * min_words - 1  # characters of min_words words: words are counted only where the line is long enough

    def line(x: Column, i: Column) -> Column:
        long_ = F.when(F.length(x) >= shortest, F.regexp_count(x, F.lit(WORD)) >= min_words).otherwise(False)
        return F.struct(i.alias("at"), F.when(x.rlike(WORD), F.xxhash64(x)).alias("h"), long_.alias("long"))

    return F.filter(F.transform(_lines(text), line), lambda s: s["h"].isNotNull())


def positions(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """doc_id, text_hash, k, h, long, lead, near: the lines that are the smallest of a window, and the long ones. k: their
    number among the lines with a word; near: the lines about them, of which `lead` come before."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), _kept(F.col("text"), min_words).alias("kept"))
    rows = rows.withColumn("ranked", F.transform("kept", lambda s, k: F.struct(s["h"].alias("h"), (-k).alias("back"))))
    n, w = F.size("kept"), min_lines
    starts = F.when(n >= w, F.sequence(F.lit(0), n - w)).otherwise(F.array().cast("array<int>"))
    least = F.transform(starts, lambda s: -F.array_min(F.slice("ranked", s + 1, F.lit(w)))["back"])
    long_ = F.filter(F.transform("kept", lambda s, k: F.when(s["long"], k)), lambda k: k.isNotNull())
    rows = rows.select("doc_id", "text_hash", "kept", F.explode(F.array_distinct(F.concat(least, long_))).alias("k"))
    own, first = F.get("kept", F.col("k")), F.greatest(F.col("k") - (w - 1), F.lit(0))
    near = F.slice("kept", first + 1, F.col("k") + w - first)
    return rows.select("doc_id", "text_hash", "k", own["h"].alias("h"), own["long"].alias("long"), (F.col("k") - first).alias("lead"), F.transform(near, lambda s: F.struct(s["at"], s["h"])).alias("near"))


def _extended(min_lines: int) -> Column:
    """array<struct<content, first, last, start>>: the windows in which a position is the smallest line, from line `first` to
    line `last`; and the position's own line if it is long."""
    w = min_lines

    def window(o: Column) -> Column:
        part = F.slice("near", o + 1, F.lit(w))
        at = lambda k: F.get("near", k)["at"]
        return F.struct(F.transform(part, lambda s: s["h"]).alias("content"), at(o).alias("first"), at(o + (w - 1)).alias("last"), (F.col("k") - F.col("lead") + o).alias("start"))

    n = F.size("near")
    windows = F.transform(F.when(n >= w, F.sequence(F.lit(0), n - w)).otherwise(F.array().cast("array<int>")), window)
    own = F.get("near", F.col("lead"))["at"]
    single = F.struct(F.array("h").alias("content"), own.alias("first"), own.alias("last"), F.col("k").alias("start"))
    return F.concat(F.filter(windows, lambda s: F.array_min(s["content"]) == F.col("h")), F.when(F.col("long"), F.array(single)).otherwise(F.slice(F.array(single), 1, 0)))


def repeated_runs(docs: DataFrame, min_lines: int = 2, min_words: int = 50) -> DataFrame:
    """doc_id, text_hash, runs: for each document with later runs, their maximal extents as array<struct<first, last>>."""
    found = materialize(positions(docs, min_lines, min_words))
    # counted before the shuffle: a line that is a third of all arrives as one row a task. Written, so that both sides of the
    # joins below come straight from exchanges and Spark's adaptive skew join can split a common fingerprint or window;
    # merged, not broadcast, as both sides grow with the texts
    often = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("start").alias("k"))
    rows = materialize(found.join(often.hint("merge"), "h").select("doc_id", "text_hash", F.inline(_extended(min_lines))).withColumn("place", place))
    earliest = rows.groupBy("content").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = rows.join(materialize(earliest.drop("n")).hint("merge"), "content").where("place != earliest")
    # the windows of one document, in order: those that touch or overlap make one run
    order = Window.partitionBy("doc_id", "text_hash").orderBy("first", "last")
    seen = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.select("doc_id", "text_hash", "first", "last").distinct().withColumn("new", (seen.isNull() | (F.col("first") > seen + 1)).cast("int"))
    numbered = marked.withColumn("run", F.sum("new").over(order))
    runs = numbered.groupBy("doc_id", "text_hash", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup(docs: DataFrame, min_lines: int = 2, min_words: int = 50) -> DataFrame:
    """Rows as struct `row` (all columns), with the text left (`kept_text`), n_lines and n_removed."""
    runs = repeated_runs(docs, min_lines, min_words)
    left = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("th"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("text_hash"))
    joined = left.join(runs, same, "left").select("row", "runs", _lines(F.col("row.text")).alias("lines"))
    stay = F.filter("lines", lambda _, i: ~F.exists("runs", lambda r: i.between(r["first"], r["last"])))
    changed = joined.withColumn("stay", F.when(F.col("runs").isNotNull(), stay))
    text = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join("stay", "\n"))
    n = F.coalesce(F.size("lines"), F.lit(0))
    removed = F.when(F.col("runs").isNull(), 0).otherwise(n - F.size("stay"))
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(n)
    return changed.select("row", text.alias("kept_text"), n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def dedup_documents(docs: DataFrame, min_lines: int = 2, min_words: int = 50) -> DataFrame:
    """The documents with later repeated runs deleted (n_chars follows, where there is one); those left without a word go."""
    out = dedup(docs, min_lines, min_words).where((F.col("n_removed") == 0) | F.col("kept_text").rlike(WORD))
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns["text"] = F.col("kept_text")
    if "n_chars" in columns:
        changed = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, changed).otherwise(columns["n_chars"])
    return out.select(*[c.alias(name) for name, c in columns.items()])


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT doc_id, line, i, lead(line) OVER o AS line2, lead(i) OVER o AS i2
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
w AS (
  SELECT doc_id, i AS first, i2 AS last, line || chr(10) || line2 AS content FROM b WHERE i2 IS NOT NULL
  UNION ALL
  SELECT doc_id, i, i, line FROM b WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS n FROM w),
gone AS (
  SELECT DISTINCT r.doc_id, l.i FROM r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN r.first AND r.last WHERE r.n > 1),
t AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
         string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
"""
