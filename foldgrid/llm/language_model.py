"""Stupid-backoff language-model scores of all documents under the n-gram counts of the corpus itself.

Documents are dealt into blocks by hash. A block sends each of its distinct n-grams once, with its count, to the
n-gram's hash bucket, where the count table lives; the table adds the blocks' counts up and sends every block the
totals of the n-grams that it asked for. Joined back, they give each word its score, and each document the sum:

    S(w | context) = count(context w) / count(context)   if the n-gram occurs `min_count` times or more,
                     alpha * S(w | shorter context)      else; count(w) / all words at the end.

At a text's start the context is what there is. Because every n-gram of a document is in the corpus, min_count is 2:
an n-gram that nothing else repeats tells nothing and backs off. N-grams are 58-bit hashes, of which an exchange
carries five bytes each: the bucket and the order of the rest say what is left.

Null texts and texts without a word have 0 words, score 0 and no mean. Null or repeated ids and repeated rows are
documents like others (repeated rows raise each other's counts); other columns are not read. An empty table gives an
empty result. A very long text is one document of one block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix, n_buckets, text_chunks, window_hashes, word_hashes

_BITS, _LOW = 58, 40
_ALL = np.uint64((1 << _BITS) - 1)  # stands for "any word": its count is the number of words
_ASK = "bucket int, level int, block int, grams binary, parts binary, counts binary"
_ASK_ARROW = pa.schema([("bucket", pa.int32()), ("level", pa.int32()), ("block", pa.int32()), ("grams", pa.binary()), ("parts", pa.binary()), ("counts", pa.binary())])
_TOLD = "block int, level int, bucket int, totals binary"
_TOLD_ARROW = pa.schema([("block", pa.int32()), ("level", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())])
_SCORES = "doc_id long, n_words long, log_score double"
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])


def pack_counts(counts: np.ndarray) -> bytes:
    """One byte a count; those of 255 and more follow in eight bytes each. Most counts are small, so deflation pays."""
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes(), 1)


def unpack_counts(packed: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(packed)
    out = np.frombuffer(raw, np.uint8, n).astype(np.uint64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n)
    return out


def pack(rest: np.ndarray, parts: int) -> tuple[bytes, bytes]:
    """Sorted integers as their low five bytes, and how many share each of the `parts` higher parts."""
    low = np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _LOW // 8])
    return low.tobytes(), pack_counts(np.bincount((rest >> np.uint64(_LOW)).astype(np.int64), minlength=parts))


def unpack(low: bytes, packed: bytes, parts: int) -> np.ndarray:
    out = np.zeros((len(low) * 8 // _LOW, 8), np.uint8)
    out[:, : _LOW // 8] = np.frombuffer(low, np.uint8).reshape(-1, _LOW // 8)
    return out.view("<u8").ravel() + (np.repeat(np.arange(parts, dtype=np.uint64), unpack_counts(packed, parts).astype(np.int64)) << np.uint64(_LOW))


def n_parts(buckets: int) -> int:
    return (((1 << _BITS) - 1) // buckets >> _LOW) + 1


def _grams(table: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each order that end at each word (0 where the text is too short), the place of each word
    in its text, and the index of each text's first word."""
    words, firsts, total = [], [], 0
    for _, _, data, offsets in text_chunks(table["text"]):
        h, first = word_hashes(data, offsets)
        words.append(h)
        firsts.append(first[:-1] + total)
        total += len(h)
    words = np.concatenate(words) if words else np.zeros(0, np.uint64)
    first = np.append(np.concatenate(firsts) if firsts else np.zeros(0, np.int64), total).astype(np.int64)
    place = np.arange(total) - np.repeat(first[:-1], np.diff(first))
    grams = []
    for k in range(1, order + 1):
        ending = np.zeros(total, np.uint64)
        ending[k - 1 :] = (window_hashes(words, k) + np.uint64(k)) if k > 1 else words
        grams.append(np.where(place >= k - 1, mix(ending) >> np.uint64(64 - _BITS), np.uint64(0)))
    return grams, place, first


def _by_bucket(every: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    bucket = (every % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    return [(int(bucket[at[0]]), at) for at in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(at)]


def _ask(order: int, buckets: int):  # noqa: ANN202
    """The distinct n-grams of a block and their counts, by order and bucket; among the words, one that stands for all."""

    def run(table: pa.Table) -> pa.Table:
        grams, place, _ = _grams(table, order)
        rows: dict[str, list] = {c: [] for c in _ASK_ARROW.names}
        for k in range(order):
            every, counts = np.unique(grams[k], return_counts=True)
            if k == 0:
                every, counts = np.append(every, _ALL), np.append(counts, len(place))
            for b, at in _by_bucket(every, buckets):
                low, parts = pack(every[at] // np.uint64(buckets), n_parts(buckets))
                for c, x in zip(rows, (b, k, table["block"][0].as_py(), low, parts, pack_counts(counts[at])), strict=True):
                    rows[c].append(x)
        return pa.table(rows, schema=_ASK_ARROW)

    return run


def _tell(buckets: int):  # noqa: ANN202
    """For one bucket of the count table: the totals of what each block asked for, in the order asked."""

    def run(table: pa.Table) -> pa.Table:
        parts = n_parts(buckets)
        asked = [unpack(a, b, parts) for a, b in zip(table["grams"].to_pylist(), table["parts"].to_pylist(), strict=True)]
        counts = np.concatenate([unpack_counts(c, len(a)) for c, a in zip(table["counts"].to_pylist(), asked, strict=True)])
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        _, at = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.split(np.bincount(at, counts)[at], cuts)
        return pa.table({"block": table["block"], "level": table["level"], "bucket": table["bucket"], "totals": [pack_counts(x) for x in totals]}, schema=_TOLD_ARROW)

    return run


def _score(order: int, buckets: int, alpha: float, min_count: int):  # noqa: ANN202
    """Scores of a block's documents from the totals that it got."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        grams, place, first = _grams(docs, order)
        got = {(k, b): t for k, b, t in zip(*(told[c].to_pylist() for c in ("level", "bucket", "totals")), strict=True)}
        score, shorter, n = np.zeros(len(place)), None, len(place)
        for k in range(order if n else 0):
            every, at = np.unique(grams[k], return_inverse=True)
            grams[k] = None
            if k == 0:
                every = np.append(every, _ALL)
            total = np.zeros(len(every))
            for b, own in _by_bucket(every, buckets):
                total[own] = unpack_counts(got[k, b], len(own))
            count = total[at]
            if k == 0:
                score = np.log(count / total[-1])
            else:
                known, before = place >= k, np.concatenate(([1.0], shorter[:-1]))
                seen = known & (count >= min_count)
                score = np.where(seen, np.log(np.where(seen, count / np.maximum(before, 1), 1)), score + np.where(known, np.log(alpha), 0.0))
            shorter = count
        # each document's own sum, not a difference of running sums: it doesn't depend on the documents beside it
        sums = np.array([score[a:b].sum() for a, b in zip(first[:-1], first[1:], strict=True)], float)
        return pa.table({"doc_id": docs["doc_id"], "n_words": np.diff(first), "log_score": sums}, schema=_SCORES_ARROW)

    return run


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """doc_id, n_words, log_score (natural logarithm, summed over words) and mean_log_score for every document."""
    n = n_buckets(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "block")
    asked = blocks.groupBy("block").applyInArrow(_ask(order, n), _ASK)
    told = asked.groupBy("bucket").applyInArrow(_tell(n), _TOLD)
    scores = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(order, n, alpha, min_count), _SCORES)
    return scores.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
           generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM documents)),
g AS (SELECT doc_id, i, w AS c, lag(w) OVER o AS b, lag(w, 2) OVER o AS a FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT c, count(*) AS n FROM g GROUP BY 1),
c2 AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY 1, 2, 3),
s AS (
  SELECT g.doc_id, CASE
      WHEN c3.n >= 2 THEN ln(c3.n / h2.n)
      ELSE CASE WHEN g.a IS NULL THEN 0 ELSE ln(0.4) END + CASE
        WHEN c2.n >= 2 THEN ln(c2.n / h1.n)
        ELSE CASE WHEN g.b IS NULL THEN 0 ELSE ln(0.4) END + ln(c1.n / (SELECT count(*) FROM w)) END END AS s
  FROM g JOIN c1 ON c1.c = g.c
  LEFT JOIN c2 ON c2.b = g.b AND c2.c = g.c LEFT JOIN c1 h1 ON h1.c = g.b
  LEFT JOIN c3 ON c3.a = g.a AND c3.b = g.b AND c3.c = g.c LEFT JOIN c2 h2 ON h2.b = g.a AND h2.c = g.b)
SELECT d.doc_id, count(s.s) AS n_words, round(coalesce(sum(s.s), 0), 4) AS log_score, round(sum(s.s) / count(s.s), 6) AS mean_log_score
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
