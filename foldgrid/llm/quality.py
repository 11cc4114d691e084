"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how reliable each is,
and the posterior probability of good quality decides, instead of a demand that every rule passes.

The variety of words is judged by stretches of 1000 words, so that it doesn't fall with the length of a text.

Null texts count as empty: no words, base_failed, not kept. Rows are judged one by one by their text, so null or
repeated ids, repeated rows and extra columns change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import weak
from .shared import materialize, text_chunks, window_hashes, word_hashes

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes long"
WINDOW = 5
STRETCH = 1000
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_BLANK = b" \t\n\r\x0b\x0c"
_CLOSING = (b".", b"!", b"?", b'"', b"'", b")", b":", b";", "…".encode(), "”".encode(), "»".encode())
_PLAIN = np.zeros(256, np.int64)  # letters, and the first bytes of characters outside ASCII
_PLAIN[[*range(65, 91), *range(97, 123), *range(194, 245)]] = 1

NEVER = (np.inf, -np.inf)
#: name, value that the rule looks at; good votes lie in the first range, bad ones in any of the others (ends included).
RULES = (
    ("symbols", NEVER, [(0.1, np.inf)]),
    ("repeats", NEVER, [(0.15, np.inf)]),
    ("dup_lines", NEVER, [(0.3, np.inf)]),
    ("length", (50, np.inf), [(-np.inf, 9)]),
    ("word_length", (3.0, 9.0), [(-np.inf, 2.2), (14.0, np.inf)]),
    ("variety", NEVER, [(-np.inf, 0.2)]),
    ("letters", (0.9, np.inf), [(-np.inf, 0.75)]),
    ("closed_lines", (0.6, np.inf), [(-np.inf, 0.1)]),
)


def repeat_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words found twice or more in the text, the first place included."""
    places: dict[tuple[bytes, ...], list[int]] = {}
    for i, window in enumerate(zip(*(words[k:] for k in range(size)), strict=False)):
        places.setdefault(window, []).append(i)
    covered = np.zeros(len(words) + 1, np.int64)
    for at in places.values():
        if len(at) > 1:
            np.add.at(covered, at, 1)
            np.add.at(covered, [i + size for i in at], -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def variety_of(hashes: np.ndarray) -> float:
    """Mean share of distinct words in stretches of STRETCH words (shorter texts are one stretch). The words left at the
    end are judged in the text's last STRETCH words and weigh by their own number, so all stretches are equally long."""
    n = len(hashes)
    size = min(n, STRETCH)
    whole = n // size
    stretches = np.sort(np.vstack([hashes[: whole * size].reshape(whole, size), hashes[None, n - size :]]), axis=1)
    share = (1 + (stretches[:, 1:] != stretches[:, :-1]).sum(axis=1)) / size
    return float((size * share[:-1].sum() + (n - whole * size) * share[-1]) / n)


def _between(x: np.ndarray, ends: tuple[float, float]) -> np.ndarray:
    return (x >= ends[0]) & (x <= ends[1])


def _chunk_stats(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    hashes, first = word_hashes(data, offsets)
    windows = window_hashes(hashes, WINDOW)
    total = lambda weights: np.diff(np.concatenate(([0], np.cumsum(weights)))[offsets])
    blank = np.isin(data, np.frombuffer(_BLANK, np.uint8))
    n_words = np.diff(first)
    chars = total(((data & 0xC0) != 0x80) & ~blank)
    symbols = total(_SYMBOL[data])
    letters = total(_PLAIN[data])
    dup, repeated, lines_n, closed = (np.zeros(n, np.int64) for _ in range(4))
    variety = np.full(n, np.nan)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        text = data[offsets[i] : offsets[i + 1]].tobytes()
        lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
        lines_n[i] = len(lines)
        dup[i] = len(lines) - len(set(lines))
        closed[i] = sum(x.rstrip(_BLANK).endswith(_CLOSING) for x in lines)
        if b - a >= WINDOW + 1:
            own = np.sort(windows[a : b - WINDOW + 1])
            if (own[1:] == own[:-1]).any():  # equal windows have equal hashes: only then can there be any
                repeated[i] = repeat_words(text.split())
        if b - a >= 20:
            variety[i] = variety_of(hashes[a:b])
    with np.errstate(divide="ignore", invalid="ignore"):
        values = {
            "symbols": symbols / n_words,
            "repeats": repeated / n_words,
            "dup_lines": np.where(lines_n > 3, dup / lines_n, np.nan),
            "length": n_words.astype(float),
            "word_length": chars / n_words,
            "variety": variety,
            # one address or number weighs much in a short text: there the rule asks for less and never votes against it
            "letters": np.where(n_words >= 30, letters / chars, np.where(letters >= 0.75 * chars, 1.0, 0.8)),
            "closed_lines": np.where(n_words >= 10, closed / lines_n, np.nan),
        }
        votes = np.stack(
            [
                _between(values[name], good).astype(np.int8) - np.any([_between(values[name], x) for x in bad], axis=0)
                for name, good, bad in RULES
            ],
            axis=1,
        )
    failed = (n_words < 10) | (100 * repeated > 20 * n_words)
    return [n_words, chars, symbols, dup, repeated, failed, weak.encode(votes)]


def stats_of(texts: pa.Array) -> pa.StructArray:
    """The base figures and the votes of each text."""
    parts = [_chunk_stats(data, offsets) for _, _, data, offsets in text_chunks(texts)]
    names = [x.split()[0] for x in STATS.split(", ")]
    kinds = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in STATS.split(", ")]
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(len(names))]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _stats(text):  # noqa: ANN001, ANN202
    def stats(texts: pa.Array) -> pa.Array:
        return stats_of(texts)

    # marked so that the optimizer doesn't copy it below a filter and run it twice
    return F.arrow_udf(stats, f"struct<{STATS.replace(' long', ':long').replace(' boolean', ':boolean')}>").asNondeterministic()(text)


def fit(scored: DataFrame, votes: str = "votes") -> dict[int, float]:
    """Posterior probability of good quality by vote code, estimated over all rows."""
    codes, counts = weak.pattern_counts(scored, votes)
    patterns = weak.decode(codes, len(RULES))
    model = weak.fit(patterns, counts)
    return dict(zip(codes.tolist(), model.posterior(patterns).tolist(), strict=True))


def _posteriors(df: DataFrame, posterior: dict[int, float]) -> DataFrame:
    """votes, quality: at most 3**8 rows, as many as patterns occur."""
    return F.broadcast(df.sparkSession.createDataFrame(sorted(posterior.items()), "votes long, quality double"))


def score(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base figures, base_failed, quality (posterior) and kept for every row of documents."""
    stats = materialize(docs.select("doc_id", _stats(F.col("text")).alias("s")).select("doc_id", "s.*"))
    out = stats.join(_posteriors(docs, fit(stats)), "votes", "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("votes")


def filter_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of good quality with all their columns. Texts are read twice and never shuffled or written: their votes are
    estimated in a first reading and found again in the second."""
    posterior = fit(docs.select(_stats(F.col("text")).alias("s")).select("s.votes"))
    judged = docs.select(F.struct("*").alias("row"), _stats(F.col("text")).alias("s"))
    judged = judged.select("row", F.col("s.votes").alias("votes"), F.col("s.base_failed").alias("failed"))
    good = judged.where("NOT failed").join(_posteriors(docs, posterior), "votes").where(F.col("quality") >= threshold)
    return good.select("row.*")
