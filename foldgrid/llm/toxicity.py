"""Toxicity by subword bags: a text's score is that of its worst window of words, whose averaged vectors go through a linear softmax.

A word is the mean of the vectors of its character n-grams (with marks at both ends) and of itself, all hashed to one table.
Table and softmax are trained together, in numpy, by stochastic gradients on labelled texts: the first pass averages whole
texts, the later ones the window that scores highest in each, so that a few words in a long text aren't drowned. Misspelt words
share most n-grams with the known ones and so their vectors.

Training takes at most `MAX_ROWS` labelled rows, in the order of a hash of the id, as long as they hold `MAX_CHARS` characters
together; each is taken whole. It is one task over that bounded sample, and what leaves it is one value for each place of
the table. All texts are scored, whole.

Null texts count as empty. A text without a word gets what the softmax gives without words.
Labels other than 0 and 1 are ignored, ids labelled both ways and null ids too. Without a labelled row every score is 0.5.
Rows stand for themselves, so repeated rows or ids get the score of their texts. Other columns, whatever their names, are no
inputs and are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix

#: Bounds of the labelled sample.
MAX_ROWS, MAX_CHARS = 8_000, 64_000_000
#: Places of the table (a power of two), width of a vector, n-gram lengths, words of a window.
PLACES, WIDTH, SIZES, WINDOW = 1 << 18, 8, (3, 4, 5, 6), 2
#: Passes over whole texts, then over windows; texts of a step; rate.
WARM, PASSES, STEP, RATE = 1, 14, 64, 0.3
WORD = re.compile(r"\w(?:\S*\w)?")
_RANDOM = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def number(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts by number, and each text's first place, with the end."""
    known: dict[str, int] = {}
    at = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
    return list(known), at, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def ngrams(words: list[str], places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Table places of the n-grams of all words in a row and of the words themselves, and each word's first one, with the end."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(size)
    char = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    sums = np.zeros(len(char) + 1, np.uint64)
    np.cumsum(mix((char << np.uint64(20)) + (np.arange(len(char)) - (ends - size)[word]).astype(np.uint64)), out=sums[1:])
    own, code = [np.arange(len(words))], [mix(sums[ends] - sums[ends - size])]
    for n in SIZES:
        if len(char) < n:
            break
        h = np.zeros(len(char) - n + 1, np.uint64)
        for k in range(n):
            h += (char[k : len(char) - n + 1 + k] + np.uint64(1)) * _RANDOM[k]
        inside = word[: len(h)] == word[n - 1 :]
        own.append(word[: len(h)][inside])
        code.append(mix(h[inside] + np.uint64(n)))
    where = np.concatenate(own)
    order = np.argsort(where, kind="stable")
    return (np.concatenate(code)[order] & np.uint64(places - 1)).astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(words)))))


def word_values(values: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of the values of each word's n-grams."""
    return np.add.reduceat(values[grams], first[:-1]) / np.diff(first) if len(first) > 1 else np.zeros(0)


def worst_windows(value: np.ndarray, starts: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place (exclusive) of each text's window of the greatest mean value, and that mean; 0 for texts without words.

    A text of fewer words is one window.
    """
    lo, hi = starts[:-1], starts[1:]
    n, total = len(value), np.concatenate(([0.0], np.cumsum(value)))
    first, last, best = lo.copy(), np.minimum(hi, lo + width), np.zeros(len(lo))
    some = hi > lo
    best[some] = ((total[last] - total[first]) / np.maximum(last - first, 1))[some]
    long_ = np.flatnonzero(hi - lo > width)
    if len(long_):
        mean = np.append((total[width:] - total[:-width]) / width, -np.inf)  # by first word; over borders too, cut off next
        open_ = np.full(n + 2, -np.inf)
        count = hi[long_] - lo[long_] - width + 1
        at = np.repeat(lo[long_] - np.cumsum(count) + count, count) + np.arange(count.sum())
        open_[: len(at)] = mean[at]
        head = np.cumsum(count) - count
        top = np.maximum.reduceat(open_[: len(at)], head)
        hit = np.flatnonzero(open_[: len(at)] == np.repeat(top, count))
        text = np.repeat(np.arange(len(count)), count)[hit]
        one = np.flatnonzero(np.diff(text, prepend=-1))
        first[long_], best[long_] = at[hit[one]], top
        last[long_] = first[long_] + width
    return first, last, best


def _spread(lengths: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin[k], begin[k] + 1, ... for lengths[k] places, in a row."""
    return np.repeat(begin - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def _summed(where: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the sums of their rows."""
    order = np.argsort(where, kind="stable")
    first = np.flatnonzero(np.diff(where[order], prepend=-1))
    return where[order][first], np.add.reduceat(rows[order], first, axis=0)


def train(texts: list[list[str]], labels: np.ndarray, places: int = PLACES, width: int = WIDTH, window: int = WINDOW, seed: int = 7) -> np.ndarray:
    """One value for each table place, and a constant at the end: the difference of both classes' outputs."""
    words, at, starts = number(texts)
    if not len(labels):
        return np.zeros(places + 1)
    grams, first = ngrams(words, places)
    rnd = np.random.default_rng(seed)
    table = rnd.uniform(-1 / width, 1 / width, (places, width))
    seen = np.full(places, 1e-3)
    out, base = rnd.normal(0, 0.5, (width, 2)), np.zeros(2)
    out_seen, base_seen = np.full(out.shape, 1e-3), np.full(2, 1e-3)
    count = np.diff(first)
    for k in range(WARM + PASSES):
        if k < WARM:
            lo, hi = starts[:-1], starts[1:]
        else:
            lo, hi, _ = worst_windows(word_values(table @ (out[:, 1] - out[:, 0]), grams, first)[at], starts, window)
        line = rnd.permutation(len(labels))
        for step in range(0, len(line), STEP):
            own = line[step : step + STEP]
            n = hi[own] - lo[own]
            text, word = np.repeat(np.arange(len(own)), n), at[_spread(n, lo[own])]
            if not len(word):
                continue
            used, word = np.unique(word, return_inverse=True)
            g = grams[_spread(count[used], first[used])]
            edge = np.cumsum(count[used]) - count[used]
            vector = np.add.reduceat(table[g], edge, axis=0) / count[used][:, None]
            mean = np.zeros((len(own), width))
            full = np.flatnonzero(n)
            mean[full] = np.add.reduceat(vector[word], (np.cumsum(n) - n)[full], axis=0) / n[full][:, None]
            z = mean @ out + base
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            back = (p @ out.T)[text] / n[text][:, None]
            _, by_word = _summed(word, back)
            touched, grad = _summed(g, np.repeat(by_word / count[used][:, None], count[used], axis=0))
            seen[touched] += (grad * grad).mean(axis=1)
            table[touched] -= RATE * grad / np.sqrt(seen[touched])[:, None]
            for x, acc, d in ((out, out_seen, mean.T @ p), (base, base_seen, p.sum(axis=0))):
                acc += d * d
                x -= 0.1 * d / np.sqrt(acc)
    return np.append(table @ (out[:, 1] - out[:, 0]), base[1] - base[0])


def logits(texts: list[list[str]], values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    words, at, starts = number(texts)
    return worst_windows(word_values(values[:-1], *ngrams(words, len(values) - 1))[at], starts, window)[2] + values[-1]


def held_out(doc_id: Column) -> Column:
    """Ids whose labels are never learnt: their checksum is divisible by five. Null ids have none."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """text and label of at most MAX_ROWS rows, in one partition, in the order of a hash of the id."""
    place = F.md5(F.col("doc_id").cast("string"))
    sure = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("_label"), F.max(label).alias("_other"))
    chosen = sure.where((F.col("_label") == F.col("_other")) & ~held_out(F.col("doc_id"))).orderBy(place, "doc_id").limit(MAX_ROWS).select("doc_id", "_label")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(place, "doc_id", "text").limit(MAX_ROWS)
    return found.select("text", F.col("_label").cast("int").alias("label")).coalesce(1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> np.ndarray:
    """Values of the table, trained in one task on the labelled sample of `docs` with `labels`(doc_id, <label>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known, held = [], [], 0
        for batch in batches:
            for text, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held += len(text or "")
                if held > MAX_CHARS:
                    break
                texts.append(words_of(text))
                known.append(y)
        yield pa.RecordBatch.from_arrays([pa.array([train(texts, np.array(known, np.int64)).tobytes()], pa.binary())], ["v"])

    got = labelled_sample(docs, labels, label).mapInArrow(run, "v binary").collect()
    return np.frombuffer(bytes(got[0].v), np.float64) if got else np.zeros(PLACES + 1)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of docs. Runs the job that trains."""
    values = fit(docs, labels, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            first, size = 0, np.cumsum([len(t or "") for t in texts])
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + (1 << 20), side="right")))
                z = logits([words_of(t) for t in texts[first:last]], values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], ["doc_id", "score"])
                first = last

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
