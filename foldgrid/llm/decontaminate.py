"""Benchmark decontamination by the q-gram lemma.

Texts and items are folded to lower-case letters and digits. A place in a text that is within `e` edits of an item of
`L` characters keeps at least L - q + 1 - q * e of its q-grams, all on diagonals (text position less item position)
that differ by at most `e`. So q-gram hits are counted in overlapping diagonal bands; bands with enough of them are
verified by a banded alignment of the whole item against the text around.

The items are the small side: their characters are counted first, and beyond `MAX_CHARS` they are taken in several
passes, none of which holds more than that on the driver or sends it to the executors: with several passes, each one's
result is written before the next pass's items are collected. Texts are read whole and never shuffled.

Null and empty texts hold no item; items that are null or have no letter or digit are found nowhere. Equal items are
all reported. Rows are judged one by one by their text, so null or repeated ids, repeated rows and extra columns
change nothing; an empty table on either side gives no hits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, mix, text_chunks

#: Folded characters of items in one pass.
MAX_CHARS = 8_000_000
_HITS = "array<struct<item:int,start:int,stop:int,edits:int>>"
_HITS_ARROW = pa.list_(pa.struct([("item", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())]))
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_FILTER = 1 << 22


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Lower case of letters and digits by code point, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalnum():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def fold(text: bytes) -> np.ndarray:
    return _fold()[np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)]


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(chars) - q + 1)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out += chars[k : k + n].astype(np.uint64) * _FACTORS[k]
    return mix(out)


class Items:
    """Benchmark items with their q-grams. An item of fewer than 2 * q characters is sought as one gram, without edits."""

    def __init__(self, texts: list[str | None], rate: float, q: int) -> None:
        self.chars = [(x := fold((t or "").encode()))[x > 0] for t in texts]
        size = np.array([len(c) for c in self.chars])
        self.q = np.where(size >= 2 * q, q, np.minimum(size, len(_FACTORS)))
        most = (size - self.q) // np.maximum(self.q, 1)  # edits that leave a q-gram for sure
        self.edits = np.where(size >= 2 * q, np.minimum((rate * size).astype(np.int64), most), 0)
        self.need = size - self.q + 1 - self.q * self.edits
        self.size, self.index = size, {}
        for width in sorted({int(w) for w in self.q[size > 0]}):
            found = [(g, np.full(len(g), k), np.arange(len(g))) for k in np.flatnonzero((self.q == width) & (size > 0)) for g in [grams(self.chars[k], width)]]
            gram, item, at = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.argsort(gram, kind="stable")
            gram, item, at = gram[order], item[order], at[order]
            known, first, count = np.unique(gram, return_index=True, return_counts=True)
            maybe = np.zeros(_FILTER, bool)
            maybe[known % np.uint64(_FILTER)] = True
            self.index[width] = (known, first, count, item, at, maybe)

    def bands(self, chars: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
        """(document, item, lowest diagonal) of every band with enough hits. doc: the document of each character."""
        out = []
        for width, (known, first, count, item, at, maybe) in self.index.items():
            g = grams(chars, width)
            place = np.flatnonzero(maybe[g % np.uint64(_FILTER)])
            place = place[doc[place] == doc[place + width - 1]]
            k = np.searchsorted(known, g[place])
            ok = k < len(known)
            ok[ok] = known[k[ok]] == g[place[ok]]
            place, k = place[ok], k[ok]
            times = count[k]
            entry = np.repeat(first[k] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
            it, diagonal, where = item[entry], np.repeat(place, times) - at[entry], np.repeat(doc[place], times)
            step = self.edits[it] + 1
            shift = int(self.size.max()) + 1  # diagonals may start before the text
            band = (diagonal + shift) // step
            where, it, band = np.tile(where, 2), np.tile(it, 2), np.concatenate([band, band - 1])
            order = np.lexsort((band, it, where))  # three arrays: packed in one number they could overflow
            where, it, band = where[order], it[order], band[order]
            new = np.ones(len(band), bool)
            new[1:] = (where[1:] != where[:-1]) | (it[1:] != it[:-1]) | (band[1:] != band[:-1])
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(band)))
            where, it, band = where[start], it[start], band[start]
            enough = n >= self.need[it]
            where, it, band = where[enough], it[enough], band[enough]
            out.append(np.stack([where, it, band * (self.edits[it] + 1) - shift], axis=1))
        return out

    def align(self, jobs: list[tuple[int, np.ndarray, int]]) -> list[tuple[int, int, int]]:
        """Fewest edits that turn each item into some part of the text beside it, and where that part starts and stops, by banded
        alignment of many at once. Of equally good parts, the one that starts first, then stops first. A job: item, characters
        from `low - edits` of its band on, zeros before the text.

        Row i of the table holds, for each diagonal of the band, the cost of the item's first i characters in its high bits and
        the place where their part of the text starts in the low ones, so both are minimised together.
        """
        items = np.array([j[0] for j in jobs])
        size, edits = self.size[items], self.edits[items]
        rows, width = int(size.max()), int((4 * edits + 3).max())
        pattern = np.zeros((len(jobs), rows), np.uint32)
        text = np.full((len(jobs), rows + width), 1, np.uint32)  # 1 is no folded character
        for r, (item, chars, _) in enumerate(jobs):
            pattern[r, : self.size[item]] = self.chars[item]
            text[r, : min(len(chars), rows + width)] = chars[: rows + width]
        outside = (text <= 1).astype(np.int64)  # dearer than leaving a character of the item out, so no part lies outside
        one = np.int64(1 << 32)
        steps = np.arange(width, dtype=np.int64)
        cost = np.tile(steps, (len(jobs), 1))
        best, end = np.full(len(jobs), 1 << 62), np.zeros(len(jobs), np.int64)
        for i in range(rows):
            new = cost + ((text[:, i : i + width] != pattern[:, i : i + 1]) + outside[:, i : i + width]) * one
            np.minimum(new[:, :-1], cost[:, 1:] + one, out=new[:, :-1])
            cost = np.minimum.accumulate(new - steps * one, axis=1) + steps * one
            done = np.flatnonzero(size == i + 1)
            if len(done):
                inside = np.where(steps < (4 * edits[done] + 3)[:, None], cost[done], 1 << 62)
                end[done] = inside.argmin(axis=1) + i + 1
                best[done] = inside.min(axis=1)
        return list(zip((best >> 32).tolist(), (best & 0xFFFFFFFF).tolist(), end.tolist(), strict=True))

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        """For each text, the items found: their number, the code points of the text from which to which, and the edits."""
        hits: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(len(offsets) - 1)]
        points = (data & 0xC0) != 0x80
        first = np.concatenate(([0], np.cumsum(points)))[offsets]
        chars = fold(data.tobytes())
        keep = chars > 0
        upto, place = np.concatenate(([0], np.cumsum(keep)))[first], np.flatnonzero(keep)
        chars = chars[keep]
        if not len(chars) or not self.index:
            return [[] for _ in hits]
        doc = np.repeat(np.arange(len(hits)), np.diff(upto))
        bands = np.concatenate(self.bands(chars, doc))
        for part in range(0, len(bands), 256):
            jobs = []
            for d, item, low in bands[part : part + 256].tolist():
                a, b, lead = upto[d], upto[d + 1], low - int(self.edits[item])
                stretch = chars[max(a, lead) : max(a, min(b, low + 3 * int(self.edits[item]) + 3 + int(self.size[item])))]
                before = np.zeros(max(0, a - lead), np.uint32)
                jobs.append((item, np.concatenate((before, stretch)), lead))
            for (item, _, lead), (edits, start, stop), (d, _, _) in zip(jobs, self.align(jobs), bands[part : part + 256].tolist(), strict=True):
                if edits <= self.edits[item]:
                    hits[d][item] = min(hits[d].get(item, (edits, lead + start, lead + stop)), (edits, lead + start, lead + stop))
        spot = lambda d, a, b: (int(place[a] - first[d]), int(place[b - 1] + 1 - first[d]))
        return [
            [{"item": item, "start": at[0], "stop": at[1], "edits": e} for item, (e, a, b) in sorted(h.items()) for at in [spot(d, a, b)]]
            for d, h in enumerate(hits)
        ]


class _Lazy:
    """Items that each worker indexes once, from the texts alone."""

    def __init__(self, *args) -> None:  # noqa: ANN002
        self.args, self.items = args, None

    def __getstate__(self) -> dict:
        return {"args": self.args, "items": None}

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        self.items = self.items or Items(*self.args)
        return self.items.search(data, offsets)


def _finder(texts: list[str | None], rate: float, q: int):  # noqa: ANN202
    items = _Lazy(texts, rate, q)

    def find(col: pa.Array) -> pa.Array:
        rows = [r for _, _, data, offsets in text_chunks(col) for r in items.search(data, offsets)]
        return pa.array(rows, _HITS_ARROW)

    return F.arrow_udf(find, _HITS).asNondeterministic()


_FOUND = "array<struct<item_id:long,start:long,stop:long,edits:long>>"
_FOUND_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("item_id", "start", "stop", "edits")]))


def _named_finder(chunk: list[tuple], rate: float, q: int):  # noqa: ANN202
    """As _finder, with the items' ids, which go with their texts to the workers."""
    items, ids = _Lazy([t for _, t in chunk], rate, q), [i for i, _ in chunk]

    def find(col: pa.Array) -> pa.Array:
        rows = [r for _, _, data, offsets in text_chunks(col) for r in items.search(data, offsets)]
        return pa.array([[{"item_id": ids[h.pop("item")], **h} for h in r] for r in rows], _FOUND_ARROW)

    return F.arrow_udf(find, _FOUND).asNondeterministic()


def _passes(items: DataFrame, max_chars: int) -> list[DataFrame]:
    """The items in passes of about `max_chars` characters at most (one item at least)."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-size // max_chars) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [items.where(part == k) for k in range(parts)]


def _collected(items: DataFrame) -> list[tuple]:
    """(id, text) of the items of one pass."""
    return [tuple(r) for r in items.select("item_id", "text").orderBy("item_id", "text").collect()]


def hits(docs: DataFrame, items: DataFrame, rate: float = 0.1, q: int = 8, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, item_id, start, stop (code points of the text, end exclusive), edits: every document with every item that it
    holds, at the place of the fewest edits (the first of several)."""
    out, passes = None, _passes(items, max_chars)
    for some in passes:
        chunk = _collected(some)
        part = docs.select("doc_id", F.inline(_named_finder(chunk, rate, q)(F.col("text"))))
        part = materialize(part) if len(passes) > 1 else part
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.1, q: int = 8, max_chars: int = MAX_CHARS) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    passes = _passes(items, max_chars)
    for some in passes:
        found: Column = F.size(_finder([t for _, t in _collected(some)], rate, q)(F.col("text")))
        docs = docs.select(F.struct("*").alias("row"), found.alias("n")).where("n = 0").select("row.*")
        docs = materialize(docs) if len(passes) > 1 else docs
    return docs
