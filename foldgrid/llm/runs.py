"""Runs of words that repeat periodically, found on a Re-Pair grammar of the word ids of each text.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least `least` words and `times`
periods long, that no neighbouring word extends keeping the period.

Each round of Re-Pair replaces, in every text, the pairs that are more frequent than all pairs that share a symbol with them
(ties by a hash of the pair), until no pair occurs twice; a pair of equal symbols counts without overlaps. What is left of a
text is joined by a balanced tree of symbols that occur once. Runs that cross the boundary inside a nonterminal are computed
once for it, where it first occurs, and translated to all places of its derivations; pieces of one period that overlap by a
period or more are one run. A run lies whole inside the lowest nonterminal around it, so none is missed. Stretches are extended
by comparing prefix hashes, and every run is then compared word by word; should one fail, its batch is done again without hashes.

Null texts have no words. Empty and blank texts have none either and collapse to an empty text. Null or repeated ids and
repeated rows change nothing, as every text stands for itself; other columns, whatever their names, are left out. Texts are
taken whole, however long; a text must fit a task. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import _powers, mix

#: Bytes of text that are compressed together; a longer text is alone.
CHUNK = 1 << 20
#: Pairs of a boundary and a period that are looked at together.
CELLS = 4_000_000
SCHEMA = "doc_id {}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Grammar:
    """Rules by symbol (those below `base` are words), and what is left of the texts."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray) -> None:
        """ids: words of all texts in a row, no id in two texts; starts: each text's first place, and the end."""
        self.base = int(ids.max()) + 1 if len(ids) else 0
        n = len(ids)
        self.symbol = ids.astype(np.int64)
        self.next = np.arange(1, n + 1)
        self.next[starts[1:][np.diff(starts) > 0] - 1] = -1
        self.prev = np.arange(-1, n - 1)
        self.alive = np.ones(n, bool)
        rules: list[tuple[np.ndarray, ...]] = []
        size = [np.ones(self.base, np.int64)]
        self.length, top = size[0], self.base
        cand = np.flatnonzero(self.next >= 0)
        if len(ids):  # a word that occurs once is in no repeated pair
            often = np.bincount(ids)[ids] > 1
            cand = cand[often[cand] & often[cand + 1]]
        while len(cand):
            a, b = self.symbol[cand], self.symbol[self.next[cand]]
            counts = (a != b) | self._even(cand, a == b)
            code = a * top + b
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            group = np.empty(len(cand), np.int64)
            group[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(cand)))
            often = np.bincount(group, counts, len(first))
            if not (often >= 2).any():
                break
            lead = order[first]
            ga, gb = a[lead], b[lead]
            rank = np.empty(len(first), np.int64)
            rank[np.lexsort((mix(code[lead].astype(np.uint64)), often))] = np.arange(len(first))
            rank[often < 2] = -1
            best = np.full(top, -1, np.int64)
            both, ranks = np.concatenate((ga, gb)), np.concatenate((rank, rank))
            up = np.argsort(ranks, kind="stable")
            best[both[up]] = ranks[up]  # of repeated places the last stays
            chosen = (rank >= 0) & (best[ga] == rank) & (best[gb] == rank)
            number = np.cumsum(chosen) - 1
            hit = chosen[group] & counts
            at, new = cand[hit], top + number[group[hit]]
            gone = self.next[at]
            after = self.next[gone]
            self.symbol[at], self.next[at], self.alive[gone] = new, after, False
            self.prev[after[after >= 0]] = at[after >= 0]
            where = np.full(int(chosen.sum()), n, np.int64)
            np.minimum.at(where, new - top, at)
            rules.append((ga[chosen], gb[chosen], where))
            size.append(self.length[ga[chosen]] + self.length[gb[chosen]])
            self.length = np.concatenate((self.length, size[-1]))
            top += len(where)
            before = self.prev[at]
            stay = cand[(often[group] >= 2) & ~chosen[group]]
            cand = np.unique(np.concatenate((stay, at, before[before >= 0])))
            cand = cand[self.alive[cand] & (self.next[cand] >= 0)]
        self.left, self.right, self.first = (np.concatenate([r[k] for r in rules]) if rules else np.zeros(0, np.int64) for k in range(3))

    def _even(self, cand: np.ndarray, same: np.ndarray) -> np.ndarray:
        """Which pairs of equal symbols don't overlap, counted from the start of their block."""
        out, at = np.zeros(len(cand), bool), np.flatnonzero(same)
        if len(at):
            head = np.ones(len(at), bool)
            head[1:] = self.next[cand[at[:-1]]] != cand[at[1:]]
            start = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            out[at] = (np.arange(len(at)) - start) % 2 == 0
        return out

    def nonterminals(self, least: int) -> tuple[np.ndarray, ...]:
        """Symbol, and start, boundary and end at its first place, of each with `least` words or more."""
        which = np.flatnonzero(self.length[self.base :] >= least)
        start = self.first[which]
        return which + self.base, start, start + self.length[self.left[which]], start + self.length[which + self.base]

    def places(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and place of every nonterminal with `least` words or more, in all derivations."""
        at = np.flatnonzero(self.alive)
        symbol, out = self.symbol[at], []
        while len(at):
            big = (symbol >= self.base) & (self.length[symbol] >= least)
            at, symbol = at[big], symbol[big]
            out.append((symbol, at))
            left, right = self.left[symbol - self.base], self.right[symbol - self.base]
            at, symbol = np.concatenate((at, at + self.length[left])), np.concatenate((left, right))
        return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(2))


def _tree(grammar: Grammar, starts: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Start, boundary and end of the nodes, `least` words or more, of balanced trees over what is left of each text."""
    start = np.flatnonzero(grammar.alive)
    end = np.append(start[1:], len(grammar.alive))
    text = np.searchsorted(starts, start, side="right")
    found = []
    while len(start):
        head = np.flatnonzero(np.diff(text, prepend=-1))
        nth = np.arange(len(text)) - np.repeat(head, np.diff(head, append=len(text)))
        left = np.flatnonzero((nth[:-1] % 2 == 0) & (text[:-1] == text[1:]))
        if not len(left):
            break
        s, m, e = start[left], start[left + 1], end[left + 1]
        big = e - s >= least
        found.append((s[big], m[big], e[big]))
        end = end.copy()
        end[left] = e
        keep = np.ones(len(start), bool)
        keep[left + 1] = False
        start, end, text = start[keep], end[keep], text[keep]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


class Extensions:
    """How far two places of a word sequence agree, forward and backward."""

    def __init__(self, ids: np.ndarray, hashed: bool = True) -> None:
        self.ids, self.hashed = ids, hashed
        if hashed:
            self.power, self.inverse = _powers(len(ids))
            self.sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum(mix((ids + 1).astype(np.uint64)) * self.power[: len(ids)], out=self.sums[1:])

    def forward(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return self._longest(a, b, limit, 1)

    def backward(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Of the words that end before a and b."""
        return self._longest(a, b, limit, -1)

    def _longest(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
        good = np.zeros(len(a), np.int64)
        if not self.hashed:
            back, open_ = int(way < 0), np.flatnonzero(limit > 0)
            while len(open_):
                k = way * good[open_] - back
                open_ = open_[self.ids[a[open_] + k] == self.ids[b[open_] + k]]
                good[open_] += 1
                open_ = open_[good[open_] < limit[open_]]
            return good
        bad = limit + 1
        while (open_ := bad - good > 1).any():
            mid = (good + bad) // 2
            lo, hi = (a, b) if way > 0 else (a - mid, b - mid)
            lo, hi, mid = lo[open_], hi[open_], mid[open_]
            same = (self.sums[lo + mid] - self.sums[lo]) * self.inverse[lo] == (self.sums[hi + mid] - self.sums[hi]) * self.inverse[hi]
            good[open_] = np.where(same, mid, good[open_])
            bad[open_] = np.where(same, bad[open_], mid)
        return good


def _periods(room: np.ndarray, times: int, sure: int) -> np.ndarray:
    """Greatest period whose share on the side with `room` words can hold half a run."""
    return np.maximum(np.minimum(2 * room // times, room - sure), 0)


def crossing(ids: np.ndarray, nodes: tuple[np.ndarray, ...], least: int, times: int, ext: Extensions) -> tuple[np.ndarray, ...]:
    """Node number, start, end and smallest period of the stretches over each node's boundary, inside the node.

    nodes: start, boundary, end. One side of the boundary has half of a run or more, so a period at least, and `sure` more words:
    of these, one on the other side, and the next ones, equality is tested before a stretch is extended.
    """
    half = -(-least // 2)
    sure = max(0, min(max(half - q, -(-times * q // 2) - q) for q in range(1, half + 1)))
    start, mid, end = nodes
    out = []
    for way in (1, -1):
        most = _periods(end - mid if way > 0 else mid - start, times, sure)
        begin = np.concatenate(([0], np.cumsum(most)))
        first = 0
        while first < len(most):
            last = max(first + 1, int(np.searchsorted(begin, begin[first] + CELLS, side="right")) - 1)
            own = most[first:last]
            node = np.repeat(np.arange(first, last), own)
            q = np.arange(len(node)) - np.repeat(begin[first:last] - begin[first], own) + 1
            m = mid[node]
            for k in range(-1, sure):  # one word beyond the boundary, then the next ones on this side
                at = m + k if way > 0 else m - 1 - k
                fit = np.flatnonzero(ids[at] == ids[at + way * q])
                node, q, m = node[fit], q[fit], m[fit]
            s, e = start[node], end[node]
            if way > 0:
                f, g = ext.forward(m, m + q, e - m - q), ext.backward(m, m + q, m - s)
                a, b = m - g, m + q + f
            else:
                f, g = ext.forward(m - q, m, e - m), ext.backward(m - q, m, m - q - s)
                a, b = m - q - g, m + f
            long_ = (b - a >= np.maximum(least, times * q)) & (a < m) & (b > m)
            out.append((node[long_], a[long_], b[long_], q[long_]))
            first = last
    node, a, b, q = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(4))
    order = np.lexsort((q, b, a, node))  # of one stretch, the smallest period
    node, a, b, q = node[order], a[order], b[order], q[order]
    new = np.ones(len(node), bool)
    new[1:] = (np.diff(node) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
    return node[new], a[new], b[new], q[new]


def _merged(a: np.ndarray, b: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Maximal intervals of each period: pieces that overlap by a period are one. By start, then period."""
    order = np.lexsort((b, a, q))
    a, b, q = a[order], b[order], q[order]
    far = np.maximum.accumulate(b + q * (n + 1)) - q * (n + 1)
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(q) != 0) | (a[1:] > far[:-1] - q[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    a, b, q = (a[first], far[last], q[first]) if len(a) else (a, b, q)
    order = np.lexsort((q, a))
    return a[order], b[order], q[order]


def find_runs(ids: np.ndarray, starts: np.ndarray, least: int = 24, times: int = 3, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """Start, end and period of all runs of all texts, by start, then period. ids, starts: as for Grammar."""
    none = np.zeros(0, np.int64)
    if len(ids) < least:
        return none, none, none
    grammar, ext = Grammar(ids, starts), Extensions(ids, hashed)
    symbol, *rules = grammar.nonterminals(least)
    node, a, b, q = crossing(ids, tuple(rules), least, times, ext)
    place_of, place = grammar.places(least)
    # each stretch of a nonterminal at each of its places
    order = np.argsort(place_of, kind="stable")
    place_of, place = place_of[order], place[order]
    low, high = np.searchsorted(place_of, symbol[node]), np.searchsorted(place_of, symbol[node], side="right")
    which = np.repeat(np.arange(len(node)), high - low)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    moved = place[low[which] + nth] - rules[0][node[which]]
    _, ta, tb, tq = crossing(ids, _tree(grammar, starts, least), least, times, ext)
    a, b, q = (np.concatenate(x) for x in ((a[which] + moved, ta), (b[which] + moved, tb), (q[which], tq)))
    a, b, q = _merged(a, b, q, len(ids))
    if hashed and not all(_holds(ids, starts, *r) for r in zip(a.tolist(), b.tolist(), q.tolist(), strict=True)):
        return find_runs(ids, starts, least, times, hashed=False)
    return a, b, q


def _holds(ids: np.ndarray, starts: np.ndarray, a: int, b: int, q: int) -> bool:
    """Whether a stretch has the period and can't be extended."""
    k = int(np.searchsorted(starts, a, side="right"))
    lo, hi = int(starts[k - 1]), int(starts[k])
    return bool((ids[a : b - q] == ids[a + q : b]).all()) and (a == lo or ids[a - 1] != ids[a - 1 + q]) and (b == hi or ids[b] != ids[b - q])


def _word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    ids, base = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        ids.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64) + base)
        base += len(known)
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield first, k
            first, held = k, 0
        held += len(t)
    if len(texts) > first:
        yield first, len(texts)


def find(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and collapsed: the words joined by one
    space, without those that any run contains after its first period. times: periods of a run, two at least."""
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")

    def one(part: list[bytes], ids: pa.Array) -> pa.RecordBatch:
        texts = [t.split() for t in part]  # the white space of bytes is the six characters that end a word
        words, starts = _word_ids(texts)
        a, b, q = find_runs(words, starts, least, times)
        text = np.searchsorted(starts, a, side="right") - 1
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for t, s, e, p in zip(text.tolist(), a.tolist(), b.tolist(), q.tolist(), strict=True):
            runs[t].append((s - int(starts[t]), e - s, p))
        collapsed = []
        for own, found in zip(texts, runs, strict=True):
            if found:
                stay = np.ones(len(own), bool)
                for s, n, p in found:
                    stay[s + p : s + n] = False
                own = [own[k] for k in np.flatnonzero(stay)]
            collapsed.append(b" ".join(own).decode())
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(starts)), pa.array(rows, kind), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for first, last in _chunks(texts):
                yield one(texts[first:last], batch.column(0).slice(first, last - first))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(dict(docs.dtypes)["doc_id"]))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; ties to the smallest start, then period. Null without runs."""
    better = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    rest = F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(runs, F.lit(0)), lambda x, y: F.when(better(x, y), y).otherwise(x))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents, of which those whose checksum h of doc_id is divisible by ten repeat a stretch of p words from word a to their end:
    with g = h div 10 and n words, a = g % n and p = 1 + (n - a) div (3 + g % 8). These texts are joined by one space."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.withColumns({"_g": g, "_w": F.when(h % 10 == 0, words)}).withColumn("_n", F.size("_w"))
    a = F.col("_g") % F.col("_n")
    p = 1 + F.floor((F.col("_n") - a) / (3 + F.col("_g") % 8))
    moved = F.transform("_w", lambda w, i: F.when(i < a, w).otherwise(F.get("_w", (a + (i - a) % p).cast("int"))))
    return chosen.withColumn("text", F.when(F.col("_n") > 0, F.array_join(moved, " ")).otherwise(F.col("text"))).drop("_g", "_w", "_n")
