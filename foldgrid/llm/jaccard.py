"""Exact n-gram Jaccard join with signature trees, for the classes of documents that links connect.

1. Texts become sets of word n-grams, as 64-bit hashes. Documents with the same set are one set from here on.
2. Hash buckets of the n-grams count in how many sets each occurs. An n-gram of one set alone links nothing, so a set
   goes on with the n-grams that it shares, and goes no further when its unshared ones alone rule out every link.
3. A set is filed under its rarest n-grams, as many as any link must touch (sorted by number of sets, then hash).
4. The sets under one n-gram form a signature tree: sets of like min-hashes share leaves; leaves and inner nodes hold the
   OR of their sets' bitmaps and their size ranges. A dual traversal drops node pairs whose largest possible overlap is
   too small. Files with more sets than `LARGE` are dealt out as pairs of blocks.
5. The first pass takes a spanning choice of candidates from each tree, the likeliest first, and compares them exactly, so
   large groups of near copies give few pairs. Within what such a choice spans (three sets or more) other candidates were
   passed over; where the links found leave several components in it, the second pass sends its sets' n-grams there, once
   a bucket, compares every pair that the tree leaves, and only links that join two components leave the task. So neither
   pass emits more rows than a few for each that it reads.

Two sets are taken for equal, and two n-grams, when their 64-bit hashes are. Null and empty texts, and texts without a
word, have an empty set and link with nothing. Rows with a null id link like others; they count in no minimum, and a
group of null ids alone has a null component. Repeated rows are documents like others. Only the id and the text are
read; other columns never matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import map_arrow, materialize, mix, n_buckets, text_chunks, window_hashes, word_hashes

#: Tokens that a task gathers before it packs them by bucket.
PACKED = 1 << 21
#: Bits of a set's signature.
WIDTH = 1024
LEAF, FAN = 32, 8
#: Files with more sets are split into blocks of about half as many.
LARGE = 8192

_EXCHANGE = "bucket int, toks binary, keys binary, runs binary, dfs binary, ids binary, nulls binary, hashes binary, ns binary, doc_keys binary"
_SETS = "doc_id long, text_hash long, n long, key long, prefix int, toks binary, dfs binary"


def _batch(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


_EXCHANGE_ARROW = pa.schema([("bucket", pa.int32()), *((x.split()[0], pa.binary()) for x in _EXCHANGE.split(", ")[1:])])
_SETS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("prefix", pa.int32()), ("toks", pa.binary()), ("dfs", pa.binary())]
)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram."""
    hashes, first = word_hashes(data, offsets, lower=True)
    windows = window_hashes(hashes, size)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            yield np.unique(windows[a : b - size + 1])
        else:
            yield window_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs with the places where it does, in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(bucket[at[0]]), at


def _pack(size: int, buckets: int):  # noqa: ANN202
    def flush(toks: list, keys: list, ids: list, hashes: list) -> pa.RecordBatch:
        counts = np.array([len(t) for t in toks], np.int64)
        keys = np.array(keys, np.uint64)
        of_set = np.repeat(np.arange(len(toks)), counts)
        out: dict[int, dict] = {}
        flat = np.concatenate(toks)
        for b, at in _slices((flat % np.uint64(buckets)).astype(np.int32)):
            own = of_set[at]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            out[b] = {"toks": flat[at].tobytes(), "keys": keys[own[starts]].tobytes(), "runs": np.diff(starts, append=len(own)).astype(np.uint32).tobytes()}
        nulls = np.array([i is None for i in ids], np.uint8)
        values = np.array([i or 0 for i in ids], np.int64)
        hashes = np.array([h or 0 for h in hashes], np.int64)
        for b, at in _slices((keys % np.uint64(buckets)).astype(np.int32)):
            out.setdefault(b, {}).update(
                ids=values[at].tobytes(), nulls=nulls[at].tobytes(), hashes=hashes[at].tobytes(), ns=counts[at].tobytes(), doc_keys=keys[at].tobytes()
            )
        names = _EXCHANGE_ARROW.names[1:]
        return _batch(_EXCHANGE_ARROW, {"bucket": list(out), **{c: [r.get(c) for r in out.values()] for c in names}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        total = 0
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, last, data, offsets in text_chunks(batch.column(1)):
                for i, toks in zip(range(first, last), shingle_sets(data, offsets, size), strict=True):
                    # texts without a word get the key 0 and no token
                    key = int(mix(np.array([mix(toks).sum() + np.uint64(len(toks))], np.uint64))[0]) | 1 if len(toks) else 0
                    for part, x in zip(held, (toks, key, ids[i], hashes[i]), strict=True):
                        part.append(x)
                    total += len(toks) + 1
                    if total > PACKED:
                        yield flush(*held)
                        held, total = ([], [], [], []), 0
        if total:
            yield flush(*held)

    return run


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table[name].to_pylist() if x), kind)


def _count(buckets: int):  # noqa: ANN202
    """For one bucket of n-grams: in how many sets each occurs; the shared ones go on to their sets' buckets."""

    def run(table: pa.Table) -> pa.Table:
        toks, keys, runs = (_joined(table, c, k) for c, k in (("toks", np.uint64), ("keys", np.uint64), ("runs", np.uint32)))
        rows = []
        if len(keys):
            _, once = np.unique(keys, return_index=True)  # sets of several documents count once
            keep = np.zeros(len(keys), bool)
            keep[once] = True
            toks, of_set = toks[np.repeat(keep, runs)], np.repeat(keys[keep], runs[keep])
            _, at, counts = np.unique(toks, return_inverse=True, return_counts=True)
            df = counts[at]
            shared = df > 1
            toks, of_set, df = toks[shared], of_set[shared], df[shared].astype(np.uint32)
            for b, i in _slices((of_set % np.uint64(buckets)).astype(np.int32)):
                rows.append({"bucket": b, "toks": toks[i].tobytes(), "keys": of_set[i].tobytes(), "dfs": df[i].tobytes()})
        docs = ("ids", "nulls", "hashes", "ns", "doc_keys")
        own = {c: b"".join(x for x in table[c].to_pylist() if x) for c in docs}
        if own["ids"]:
            rows.append({"bucket": table["bucket"][0].as_py(), **own})
        return pa.Table.from_batches([_batch(_EXCHANGE_ARROW, {c: [r.get(c) for r in rows] for c in _EXCHANGE_ARROW.names})], _EXCHANGE_ARROW)

    return run


def _gather(percent: int):  # noqa: ANN202
    """For one bucket of sets: a row for each document, and one for each set that can still have a link."""

    def run(table: pa.Table) -> pa.Table:
        ids, nulls, hashes, ns, doc_keys = (
            _joined(table, c, k) for c, k in (("ids", np.int64), ("nulls", np.uint8), ("hashes", np.int64), ("ns", np.int64), ("doc_keys", np.uint64))
        )
        toks, keys, dfs = (_joined(table, c, k) for c, k in (("toks", np.uint64), ("keys", np.uint64), ("dfs", np.uint32)))
        documents = pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=nulls.astype(bool)),
                pa.array(hashes),
                pa.array(ns),
                pa.array(doc_keys.view(np.int64)),
                *(pa.nulls(len(ids), f.type) for f in list(_SETS_ARROW)[4:]),
            ],
            schema=_SETS_ARROW,
        )
        out: dict[str, list] = {"n": [], "key": [], "prefix": [], "toks": [], "dfs": []}
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, toks, dfs = keys[order], toks[order], dfs[order]
            starts = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint64(1)))
            ends = np.append(starts[1:], len(keys))
            known, at = np.unique(doc_keys, return_index=True)
            n = ns[at[np.searchsorted(known, keys[starts])]]
            prefix = n - (percent * n + 99) // 100 + 1 - (n - (ends - starts))
            for k in np.flatnonzero(prefix > 0):
                a, b = starts[k], ends[k]
                rare = np.lexsort((toks[a:b], dfs[a:b]))
                for name, x in zip(out, (int(n[k]), int(keys[a].view(np.int64)), int(prefix[k]), toks[a:b][rare].tobytes(), dfs[a:b][rare].tobytes()), strict=True):
                    out[name].append(x)
        return pa.Table.from_batches([documents, _batch(_SETS_ARROW, out)], _SETS_ARROW)

    return run


def signature(toks: np.ndarray, width: int = WIDTH) -> np.ndarray:
    bits = np.zeros(width, np.uint8)
    bits[toks % np.uint64(width)] = 1
    return np.packbits(bits).view(np.uint64)


_FILED = "token long, block int, other int, own int, key long, n long, m long, like long, bits binary"
_FILED_ARROW = pa.schema(
    [
        ("token", pa.int64()), ("block", pa.int32()), ("other", pa.int32()), ("own", pa.int32()), ("key", pa.int64()),
        ("n", pa.int64()), ("m", pa.int64()), ("like", pa.int64()), ("bits", pa.binary()),
    ]
)
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 4, dtype=np.uint64)


def likeness(toks: np.ndarray) -> int:
    """Four short min-hashes in one number: sets that share most n-grams mostly share the first, so sorting brings them together."""
    return int.from_bytes(b"".join(int(mix(toks ^ seed).min() >> np.uint64(48)).to_bytes(2, "big") for seed in _SEEDS), "big", signed=True)


def _file(large: int):  # noqa: ANN202
    """A row for each set and each n-gram under which it is filed; under very frequent ones, for each pair of blocks."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {c: [] for c in _FILED_ARROW.names}
        for key, n, prefix, toks, dfs in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            toks, dfs = np.frombuffer(toks, np.uint64), np.frombuffer(dfs, np.uint32)
            bits, like = signature(toks).tobytes(), likeness(toks)
            for tok, df in zip(toks[:prefix].view(np.int64).tolist(), dfs[:prefix].tolist(), strict=True):
                blocks = 1 if df <= large else -(-2 * df // large)
                own = key % blocks
                for other in range(blocks):
                    for name, x in zip(out, (tok, min(own, other), max(own, other), own, key, n, len(toks), like, bits), strict=True):
                        out[name].append(x)
        yield _batch(_FILED_ARROW, out)

    return run


class Tree:
    """Sets of one file in the order given, in leaves of LEAF and inner nodes of FAN: OR of the bitmaps, ranges of sizes."""

    def __init__(self, n: np.ndarray, m: np.ndarray, bits: np.ndarray) -> None:
        self.n, self.m, self.bits, self.pop = n, m, bits, np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [self._level(np.arange(0, len(n), LEAF), bits, n, n, m, self.pop)]
        while len(self.levels[-1]["at"]) > 1:
            x = self.levels[-1]
            up = self._level(np.arange(0, len(x["at"]), FAN), x["bits"], x["low"], x["high"], x["most"], x["pop"])
            self.levels.append(up)

    @staticmethod
    def _level(at, bits, low, high, most, pop) -> dict:  # noqa: ANN001
        return {
            "at": at,
            "bits": np.bitwise_or.reduceat(bits, at, axis=0),
            "low": np.minimum.reduceat(low, at),
            "high": np.maximum.reduceat(high, at),
            "most": np.maximum.reduceat(most, at),
            "pop": np.minimum.reduceat(pop, at),
        }

    def nodes(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which of the node pairs may hold a link."""
        x = self.levels[level]
        common = np.bitwise_count(x["bits"][a] & x["bits"][b]).sum(axis=1).astype(np.int64)
        # a set has at least `pop` bits, at most `common` of them in the other node: so many n-grams are surely missing
        over = np.minimum(*(x["most"][k] - np.maximum(0, x["pop"][k] - common) for k in (a, b)))
        fits = (100 * x["high"][a] >= percent * x["low"][b]) & (100 * x["high"][b] >= percent * x["low"][a])
        return fits & ((100 + percent) * over >= percent * (x["low"][a] + x["low"][b]))

    def leaf_pairs(self, percent: int) -> Iterator[tuple[int, int]]:
        """Dual traversal: pairs of leaves (a <= b) that the bounds leave."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            left = self.nodes(level, a, b, percent)
            a, b = a[left], b[left]
            if level:
                below, span = len(self.levels[level - 1]["at"]), np.arange(FAN)
                pa_, pb = np.repeat(a * FAN, FAN * FAN) + np.tile(np.repeat(span, FAN), len(a)), np.repeat(b * FAN, FAN * FAN) + np.tile(span, FAN * len(b))
                ok = (pa_ < below) & (pb < below) & (pa_ <= pb)
                a, b = pa_[ok], pb[ok]
        yield from zip(a.tolist(), b.tolist(), strict=True)


def slack(n1, n2, m1, m2, bits1, bits2, percent: int) -> np.ndarray:  # noqa: ANN001
    """By how much the largest possible overlap, by sizes and by n-grams whose bit the other set lacks, passes a link's; below
    0 there is none. Divided by the sizes."""
    only1 = np.bitwise_count(bits1 & ~bits2).sum(axis=1).astype(np.int64)
    only2 = np.bitwise_count(bits2 & ~bits1).sum(axis=1).astype(np.int64)
    over = np.minimum(m1 - only1, m2 - only2)
    return ((100 + percent) * over - percent * (n1 + n2)) / (n1 + n2)


def _leaf_rows(a: int, b: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of the sets of two leaves."""
    i, j = np.arange(a * LEAF, min((a + 1) * LEAF, n)), np.arange(b * LEAF, min((b + 1) * LEAF, n))
    i, j = np.repeat(i, len(j)), np.tile(j, len(i))
    return i[i < j], j[i < j]


def _group_pairs(n, m, bits, part, label, like, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Candidate pairs of one file, by its tree: as many as connect what all candidates would, the likeliest of each two
    leaves first. part: the block of each set (pairs of one block are for another task). Last, the label that each set has
    after the pairs: candidates passed over have equal ones."""
    order = np.lexsort((n, like))
    n, m, bits, part, label = n[order], m[order], bits[order], part[order], label[order].copy()
    across, left = part.min() != part.max(), len(np.unique(label))
    tree, found = Tree(n, m, bits), []
    for a, b in tree.leaf_pairs(percent) if left > 1 else ():
        i, j = _leaf_rows(a, b, len(n))
        ok = (label[i] != label[j]) & ((part[i] != part[j]) | (not across))
        i, j = i[ok], j[ok]
        room = slack(n[i], n[j], m[i], m[j], bits[i], bits[j], percent)
        best = np.argsort(-room, kind="stable")[: int((room >= 0).sum())]
        i, j = i[best], j[best]
        while len(i):  # one pair for each two labels that meet, then those labels are one
            found.append((int(i[0]), int(j[0])))
            label[label == label[j[0]]] = label[i[0]]
            left -= 1
            ok = label[i] != label[j]
            i, j = i[ok], j[ok]
        if left == 1:
            break
    pairs, spanned = np.array(found, np.int64).reshape(-1, 2), np.empty_like(label)
    spanned[order] = label
    return order[pairs[:, 0]], order[pairs[:, 1]], spanned


_PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_CHOSEN = "a long, b long, span long"
_CHOSEN_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("span", pa.int64())])


def _candidates(percent: int):  # noqa: ANN202
    """Over rows sorted by file: all pairs of small files, for a batch at once, and spanning ones of larger files by their trees.
    Rows without b: a set, and the number of what a choice spans in a file, where other candidates were passed over."""

    def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n, m, bits, part, like, name, group = cols
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        ends = np.append(starts[1:], len(group))
        sizes = np.repeat(ends - starts, ends - starts)
        pairs, spans = [], []
        for step in range(1, 8):  # files of up to 8 sets: a tree of one leaf, so all their pairs against the bounds
            i = np.flatnonzero(sizes[: len(group) - step] <= 8) if step < len(group) else np.zeros(0, np.int64)
            j = i + step
            ok = (group[i] == group[j]) & (keys[i] != keys[j])
            i, j = i[ok], j[ok]
            ok = slack(n[i], n[j], m[i], m[j], bits[i], bits[j], percent) >= 0
            pairs.append((i[ok], j[ok]))
        for a, b in zip(starts, ends, strict=True):
            if b - a > 8:
                i, j, label = _group_pairs(n[a:b], m[a:b], bits[a:b], part[a:b], keys[a:b], like[a:b], percent)
                pairs.append((i + a, j + a))
                _, at, count = np.unique(label, return_inverse=True, return_counts=True)
                more = count[at] > 2
                spans.append((keys[a:b][more], mix(name[a:b][more] ^ mix(label[more].view(np.uint64))).view(np.int64)))
        i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        lo, hi = np.minimum(keys[i], keys[j]), np.maximum(keys[i], keys[j])
        if len(lo):
            both = np.unique(np.stack([lo, hi], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64())], schema=_CHOSEN_ARROW)
        for some, span in spans:
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.nulls(len(some), pa.int64()), pa.array(span)], schema=_CHOSEN_ARROW)

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        col = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
        bits = np.frombuffer(b"".join(col["bits"].to_pylist()), np.uint64).reshape(-1, WIDTH // 64)
        ints = {c: col[c].to_numpy(zero_copy_only=False) for c in ("key", "n", "m", "own", "like", "token", "block", "other")}
        change = np.zeros(len(bits), bool)
        for c in ("token", "block", "other"):
            change[1:] |= ints[c][1:] != ints[c][:-1]
        file = (int(ints["token"][0]), int(ints["block"][0]), int(ints["other"][0])), (int(ints["token"][-1]), int(ints["block"][-1]), int(ints["other"][-1]))
        name = mix(ints["token"].view(np.uint64) ^ mix((ints["block"].astype(np.uint64) << np.uint64(32)) | ints["other"].astype(np.uint64)))
        return [ints["key"], ints["n"], ints["m"], bits, ints["own"], ints["like"], name, np.cumsum(change)], file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        open_file = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols, (first, last) = arrays(batch)
            if held is not None:
                cols[7] = cols[7] + held[7][-1] + (first != open_file)
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(cols[7], cols[7][-1]))  # the last file may go on in the next batch
            if cut:
                yield from emit([x[:cut] for x in cols])
            held, open_file = [x[cut:] for x in cols], last
        if held is not None:
            yield from emit(held)

    return run


def _verify(percent: int):  # noqa: ANN202
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b, na, nb, ta, tb = (batch.column(k) for k in range(6))
        keep = []
        for x, y, n1, n2 in zip(ta, tb, na.to_pylist(), nb.to_pylist(), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate((x, y)))
            over = int((both[1:] == both[:-1]).sum())
            keep.append(100 * over >= percent * (n1 + n2 - over))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], schema=_PAIRS_ARROW)

    return run


def _overlaps(toks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common n-grams of each pair of sets, counted exactly: a product of 0/1 rows where many pairs meet, else one by one."""
    own, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    total = sum(len(toks[k]) for k in own)
    if len(i) > 8 and len(own) * total <= 1 << 24:
        values, place = np.unique(np.concatenate([toks[k] for k in own]), return_inverse=True)
        rows = np.zeros((len(own), len(values)), np.float32)
        rows[np.repeat(np.arange(len(own)), [len(toks[k]) for k in own]), place] = 1
        return np.rint(rows @ rows.T)[at[: len(i)], at[len(i) :]].astype(np.int64)
    out = np.zeros(len(i), np.int64)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        spot = np.searchsorted(toks[y], toks[x])
        spot[spot == len(toks[y])] = 0
        out[k] = (toks[y][spot] == toks[x]).sum()
    return out


def _exact_links(percent: int):  # noqa: ANN202
    """Over one partition of (key, n, label, spans, toks): links between different labels in each span, and as many of them as
    connect what all would."""

    def signatures(toks: list[np.ndarray]) -> np.ndarray:
        width = int(min(1 << 14, max(WIDTH, 1 << (4 * int(np.median([len(t) for t in toks]))).bit_length())))
        return np.stack([signature(t, width) for t in toks])

    def in_file(keys: np.ndarray, n: np.ndarray, label: np.ndarray, toks: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        order = np.lexsort((n, np.array([likeness(t) for t in toks])))
        keys, n, label, toks = keys[order], n[order], label[order].copy(), [toks[k] for k in order]
        left, m, bits = len(np.unique(label)), np.array([len(t) for t in toks]), signatures(toks)
        for a, b in Tree(n, m, bits).leaf_pairs(percent):
            i, j = _leaf_rows(a, b, len(n))
            ok = label[i] != label[j]
            i, j = i[ok], j[ok]
            ok = slack(n[i], n[j], m[i], m[j], bits[i], bits[j], percent) >= 0
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            over = _overlaps(toks, i, j)
            ok = 100 * over >= percent * (n[i] + n[j] - over)
            i, j = i[ok], j[ok]
            while len(i):
                yield keys[i[0]], keys[j[0]]
                label[label == label[j[0]]] = label[i[0]]
                left -= 1
                ok = label[i] != label[j]
                i, j = i[ok], j[ok]
            if left == 1:
                break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        keys, n, label = (table[c].to_numpy() for c in ("key", "n", "label"))
        toks = [np.sort(np.frombuffer(t.as_buffer(), np.uint64)) for t in table["toks"]]
        lists = table["spans"].combine_chunks()
        own, span = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        root: dict[int, int] = {}  # labels that links in earlier spans of this task made one

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        order = np.lexsort((keys[own], span))
        for at in np.split(own[order], np.flatnonzero(np.diff(span[order])) + 1):
            now = np.array([find(x) for x in label[at].tolist()], np.int64)
            if len(at) < 2 or now.min() == now.max():
                continue
            known = dict(zip(keys[at].tolist(), now.tolist(), strict=True))
            links = list(in_file(keys[at], n[at], now, [toks[k] for k in at]))
            for a, b in links:
                root[find(known[b])] = find(known[a])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in links], pa.int64()) for k in (0, 1)], schema=_PAIRS_ARROW)

    return run


#: Shares into which the rows of a span are dealt where spans are looked up by number.
SALTS = 8


def _first_links(filed: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Exactly verified links among a spanning choice of the candidates of all files; and (key, span) of the sets between which
    candidates were passed over."""
    file = ["token", "block", "other"]
    rows = filed.repartition(n_buckets(filed.sparkSession), *file).sortWithinPartitions(*file)
    chosen = materialize(rows.mapInArrow(_candidates(percent), _CHOSEN))
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    pairs = chosen.where("b IS NOT NULL").select("a", "b").distinct()
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb")
    links = materialize(map_arrow(both, _verify(percent), "a long, b long"))
    return links, chosen.where("b IS NULL").select(F.col("a").alias("key"), "span")


def _more_links(spans: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between the components that the labels name, from the spans in which several of them meet."""
    buckets = n_buckets(spans.sparkSession)
    rows = spans.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "span", F.coalesce("root", "key").alias("label"))
    rows = materialize(rows)
    mixed = rows.groupBy("span").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("span")
    mixed = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.col("key"), F.lit(SALTS)).cast("int"))
    met = salted.join(mixed, ["span", "salt"]).groupBy("key", "label").agg(F.collect_list("span").alias("spans"))
    asked = met.join(sets.select("key", "n", "toks"), "key")
    bucket = F.explode(F.array_distinct(F.transform("spans", lambda f: F.pmod(f, F.lit(buckets)))))
    dealt = asked.withColumn("bucket", bucket).withColumn("spans", F.filter("spans", lambda f: F.pmod(f, F.lit(buckets)) == F.col("bucket")))
    dealt = dealt.repartition(buckets, "bucket").select("key", "n", "label", "spans", "toks")
    return materialize(dealt.mapInArrow(_exact_links(percent), "a long, b long"))


def classes(docs: DataFrame, size: int = 5, percent: int = 80, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(rows, roots) for docs(doc_id, text): rows has doc_id, text_hash, n and the set's key; roots maps linked keys to a root.

    Two documents link when 100 * intersection >= percent * union of their sets of `size`-word n-grams.
    """
    spark = docs.sparkSession
    buckets = n_buckets(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash"))
    packed = slim.mapInArrow(_pack(size, buckets), _EXCHANGE)
    counted = packed.groupBy("bucket").applyInArrow(_count(buckets), _EXCHANGE)
    found = materialize(counted.groupBy("bucket").applyInArrow(_gather(percent), _SETS))
    rows = found.where("toks IS NULL").select("doc_id", "text_hash", "n", "key")
    sets = found.where("toks IS NOT NULL").select("key", "n", "prefix", "toks", "dfs")
    filed = materialize(map_arrow(sets, _file(large), _FILED))
    links, spans = _first_links(filed, sets, percent)
    more = _more_links(spans, sets, components(links), percent)
    return rows, components(links.union(more))


def join_components(docs: DataFrame, size: int = 4, percent: int = 85, large: int = LARGE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included) for every document."""
    rows, roots = classes(docs, size, percent, large)
    least = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    least = least.join(roots, least["key"] == roots["node"], "left").select("key", F.coalesce("root", "key").alias("root"), "least")
    component = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = least.join(component, "root").select("key", "component_id")
    joined = rows.join(of_key, "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, large: int = LARGE) -> DataFrame:
    """The documents less all but one of each class: the one of smallest doc_id (nulls last), then text hash, stays.

    Rows of equal doc_id and text are one document; where its class keeps it, one of them stays: the one whose columns
    together have the smallest hash.
    """
    rows, roots = classes(docs.select("doc_id", "text"), size, percent, large)
    rows = rows.where("n > 0").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    rows = materialize(rows.withColumn("place", place).select("root", "place"))
    best = rows.groupBy("root").agg(F.min("place").alias("best"))
    gone = rows.join(best, "root").where("place != best").select("place").distinct()
    whole = docs.select(F.struct("*").alias("row"))
    own = F.struct(F.col("row.doc_id").isNull().alias("n"), F.col("row.doc_id").cast("long").alias("d"), F.xxhash64("row.text").alias("t"))
    kept = whole.withColumn("place", own).join(gone, "place", "left_anti")
    twice = materialize(rows.groupBy("place").count().where("count > 1").select("place"))
    if twice.isEmpty():
        return kept.select("row.*")
    first = kept.join(twice, "place", "left_semi").groupBy("place").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.join(twice, "place", "left_anti").select("row.*").union(first.select("row.*"))


#: join_components() with 4 words and 85 percent.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS k FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
r AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
