"""Mixing sources to target weights by a min-cost flow over groups of documents.

Documents that belong to the same sources form a pattern: by default, the sources in which a document's text occurs, so
copies of one text in several sources belong to all of them. The flow sends words from patterns to source quotas; a
pattern's words cost nothing the first time they are taken and more each further time, so fresh words go first and a
source draws on texts that it shares with others only as far as its own don't do. What the flow takes of a pattern is then
filled with documents in a seeded order; those that would go beyond are passed over for later, smaller ones, and the one
document left that best fills the rest comes last. Only totals by pattern reach the driver: one row for each set of sources that occurs, refused beyond
`max_patterns`.

Null texts count as empty (0 words): nothing is taken of them. A null source is a source of its own, last in order.
Rows are taken as they come: repeated rows are documents of their own. Rows of equal doc_id and text have the same draw and
are taken all or none. Of documents that fill what is left equally well, the first drawn goes in. An empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialize


#: Bits of a document's draw, and of the slices of the draws in which a pattern's words are totalled first.
DRAW_BITS, SLICE_BITS = 60, 12
#: How often documents that don't fit are passed over; what is left after that is less than one of the documents passed over.
ROUNDS = 4


def seeded_draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number of DRAW_BITS bits by seed, id and text: the same on every run and in any SQL engine."""
    mixed = F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(mixed), 1, DRAW_BITS // 4), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Targets in the weights' proportions that sum to `share` of all sizes, none above `most` times its own size.

    What a target would have beyond its bound is dealt to the others by weight until none is above.
    """
    targets, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in full or open_:
            targets[i] = most * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def _levels(words: int, most: int) -> Iterator[tuple[int, int]]:
    """(words, cost) of each taking: the first is free, the second costs 1, the next two 2, the next four 3 and so on, up to
    `most` words in all. Costs rise with repetition, so they are convex."""
    step, cost, left = words, 0, most
    while words and left > 0:
        yield min(step, left), cost
        left -= step
        step, cost = step * (2 if cost else 1), cost + 1


def min_cost_flow(patterns: Sequence[tuple[int, dict[int, int]]], quotas: Sequence[int], caps: Sequence[int] | None = None) -> list[dict[int, int]]:
    """Words that each source gets of each pattern. A pattern: its words, and the most that each of its sources may take.
    caps: the most that is taken of each pattern in all.

    As much as the quotas and patterns allow, at the least cost by _levels(). Potentials by shortest paths, then blocking
    flows over the arcs without reduced cost: as many rounds as there are path costs, not one for each path.
    """
    source, sink = len(patterns) + len(quotas), len(patterns) + len(quotas) + 1
    head, room, price, out = [], [], [], [[] for _ in range(sink + 1)]  # arc k and its way back k ^ 1

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        for x, y, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[x].append(len(head))
            head.append(y)
            room.append(c)
            price.append(p)

    for p, (words, most) in enumerate(patterns):
        for capacity, cost in _levels(words, caps[p] if caps else sum(most.values())):
            arc(source, p, capacity, cost)
        for s in sorted(most):
            arc(p, len(patterns) + s, most[s], 0)
    for s, quota in enumerate(quotas):
        arc(len(patterns) + s, sink, quota, 0)
    height = [0] * (sink + 1)
    while True:
        far, heap = [float("inf")] * (sink + 1), [(0, source)]
        far[source] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k in out[a]:
                if room[k] and (e := d + price[k] + height[a] - height[head[k]]) < far[head[k]]:
                    far[head[k]] = e
                    heapq.heappush(heap, (e, head[k]))
        if far[sink] == float("inf"):
            break
        height = [h + int(min(d, far[sink])) for h, d in zip(height, far, strict=True)]
        while True:  # blocking flows along the fewest arcs
            level, front = [-1] * (sink + 1), [source]
            level[source] = 0
            while front and level[sink] < 0:
                after = []
                for a in front:
                    for k in out[a]:
                        b = head[k]
                        if level[b] < 0 and room[k] and price[k] + height[a] == height[b]:
                            level[b] = level[a] + 1
                            after.append(b)
                front = after
            if level[sink] < 0:
                break
            at, path, a = [0] * (sink + 1), [], source
            while True:
                if a == sink:
                    flow = min(room[k] for k in path)
                    for k in path:
                        room[k] -= flow
                        room[k ^ 1] += flow
                    path, a = [], source
                    continue
                while at[a] < len(out[a]):
                    k = out[a][at[a]]
                    if room[k] and level[head[k]] == level[a] + 1 and price[k] + height[a] == height[head[k]]:
                        break
                    at[a] += 1
                else:
                    if a == source:
                        break
                    k = path.pop()  # a dead end
                    a = head[k ^ 1]
                    at[a] += 1
                    continue
                path.append(k)
                a = head[k]
    return [{head[k] - len(patterns): room[k ^ 1] for k in out[p] if not k % 2} for p in range(len(patterns))]


def _patterns(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each distinct text with member, its sources, and size; text and member of those of several sources)."""
    once = slim.groupBy("text", "own").agg(F.max("size").alias("size"))  # copies meet before the shuffle
    texts = once.groupBy("text").agg(F.array_sort(F.collect_list("own")).alias("of"), F.max("size").alias("size"))
    texts = materialize(texts.select("text", "size", F.array_join("of", "\n").alias("member"), (F.size("of") > 1).alias("shared")))
    return texts, materialize(texts.where("shared").select("text", "member"))


def mix(
    docs: DataFrame,
    sources: Column | None = None,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 17,
    max_patterns: int = 100_000,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The rows with size, source_size, target (both of a row's own source) and taken: the words the mix takes.

    Without `sources`, a document's own source is its column `source`, and its pattern the sources in which its text occurs. Or
    `sources` is an array of the sources to which a document belongs, the first of which, in order, is its own. `weights`
    repeat over the sources in code-point order, null last. A document is taken whole, 0 to `most` times. The columns of
    docs (or those in `columns`) come under the struct `row`. Writes small tables and collects the totals by pattern.
    """
    single = lambda s: F.to_json(F.array(s))
    own = single(F.col("source").cast("string")) if sources is None else F.lit("")
    rows = docs.select(
        F.struct(*(columns or docs.columns)).alias("row"),
        own.alias("own"),
        (F.lit("") if sources is None else F.to_json(F.array_sort(F.array_distinct(sources)))).alias("member"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"),
        n_words(F.col("text")).alias("size"),
        seeded_draw(seed, F.col("doc_id") if "doc_id" in docs.columns else F.lit(""), F.col("text")).alias("draw"),
    )
    slim = materialize(rows.select("own", "member", "text", "size", "draw"))
    if sources is None:
        texts, shared = _patterns(slim)
        # `shared` is written, so Spark knows its size and sends it to the rows while it is small
        slim, rows = (x.drop("member").join(shared, "text", "left").withColumn("member", F.coalesce("member", "own")) for x in (slim, rows))
    else:
        texts = slim
    fresh = texts.groupBy("member").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(fresh) > max_patterns:
        raise ValueError(f"more than {max_patterns} sets of sources")
    units = {(r["member"], r["own"]): r["size"] for r in slim.groupBy("member", "own").agg(F.sum("size").alias("size")).collect()}

    def of(text: str) -> list[str | None]:  # JSON arrays of source names, one a line
        return [s for line in text.split("\n") if line for s in json.loads(line)]

    members = {r["member"]: of(r["member"]) for r in fresh}
    names = sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, (s or "").encode()))
    at = {s: k for k, s in enumerate(names)}
    found = sorted((sorted(at[s] for s in members[r["member"]]), r["member"], r["size"]) for r in fresh)
    within = {(m, at[of(o)[0]] if o else None): (o, n) for (m, o), n in units.items()}
    whole = {m: n for (m, k), (_, n) in within.items() if k is None}
    words = lambda m, k: whole[m] if m in whole else within[m, k][1]
    sizes = [sum(words(m, k) for ks, m, _ in found if k in ks) for k in range(len(names))]
    targets = water_fill(sizes, [weights[k % len(weights)] for k in range(len(names))], share, most)
    patterns = [(n, {k: most * words(m, k) for k in ks}) for ks, m, n in found]
    caps = None if sources is None else [most * n for n, _ in patterns]  # a document of several sources is taken `most` times in all
    flows = min_cost_flow(patterns, [round(t) for t in targets], caps)
    plan = []
    for (ks, m, _), flow in zip(found, flows, strict=True):
        for k in ks if m not in whole else ks[:1] or [None]:
            o, n = within[m, None if m in whole else k]
            taken = sum(flow.values()) if m in whole else flow.get(k, 0)
            plan.append((m, o, sizes[k] if k is not None else 0, float(targets[k]) if k is not None else 0.0, *(divmod(taken, n) if n else (0, 0))))
    # one row for each pattern and source of it: at most max_patterns times the sources
    plan = F.broadcast(docs.sparkSession.createDataFrame(plan, "member string, own string, source_size long, target double, rounds long, rest long"))
    stretches, fillers = _choose(slim.join(plan, ["member", "own"]).where("rest > 0"))
    known = rows.join(plan, ["member", "own"]).join(F.broadcast(stretches), ["member", "own"], "left").join(F.broadcast(fillers), ["member", "own"], "left")
    again = F.when(_within("draw", "size") | (F.col("draw") == F.col("filler")), F.col("size")).otherwise(0)
    return known.select("row", "size", "source_size", "target", (F.col("rounds") * F.col("size") + again).alias("taken"))


_UNIT = ["member", "own"]
_STRETCH = "member string, own string, stretches array<struct<after: long, until: long, most: long>>"


def _within(draw: str, size: str) -> Column:
    """Whether a document is in one of the stretches of its unit."""
    inside = lambda x: (F.col(draw) > x["after"]) & (F.col(draw) < x["until"]) & (F.col(size) <= x["most"])
    return F.coalesce(F.exists("stretches", inside), F.lit(False))


def _choose(planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each pattern and source whose `rest` words are taken once more: stretches of draws with the greatest size taken
    in each, and the draw of one more document (`filler`), if it brings the words nearer to what was asked.

    A stretch ends before the first document that would go beyond; the next starts after it, with documents no larger
    than what is left. The driver holds a row for each pattern and source, as it does for the plan.
    """
    spark = planned.sparkSession
    asked = {(r["member"], r["own"]): r["rest"] for r in planned.select(*_UNIT, "rest").distinct().collect()}
    gap, after, stretches = dict(asked), dict.fromkeys(asked, -1), {u: [] for u in asked}
    open_ = set(asked)
    for _ in range(ROUNDS):
        if not open_:
            break
        found = {(r["member"], r["own"]): r for r in _border(planned, [(*u, after[u], gap[u]) for u in sorted(open_)]).collect()}
        for u in list(open_):
            r = found.get(u)
            if r is not None:
                stretches[u].append((after[u], 1 << DRAW_BITS if r["border"] is None else r["border"], gap[u]))
                gap[u] -= r["filled"]
            if r is None or r["border"] is None or not gap[u]:
                open_.discard(u)
            else:
                after[u] = r["border"]
    chosen = spark.createDataFrame([(*u, s) for u, s in stretches.items()], _STRETCH)
    gaps = spark.createDataFrame([(*u, g) for u, g in gap.items() if g], "member string, own string, gap long")
    left = planned.join(F.broadcast(gaps), _UNIT).join(F.broadcast(chosen), _UNIT).where(~_within("draw", "size"))
    copies = left.groupBy(*_UNIT, "draw", "gap").agg(F.sum("size").alias("words"))  # of one draw, so taken together
    miss = F.abs(F.col("words") - F.col("gap"))
    return chosen, materialize(copies.where(miss < F.col("gap")).groupBy(*_UNIT).agg(F.min_by("draw", F.struct(miss, "draw")).alias("filler")))


def _border(planned: DataFrame, state: list[tuple[str, str, int, int]]) -> DataFrame:
    """member, own, the first draw later than `after` that with those before it goes beyond `gap` (null: none), and the words
    before it, of documents no larger than `gap`.

    Words are totalled by slice of the hash range first, so only the documents of one slice are put in order.
    """
    state = F.broadcast(planned.sparkSession.createDataFrame(state, "member string, own string, after long, gap long"))
    open_ = planned.select(*_UNIT, "draw", "size").join(state, _UNIT).where("size BETWEEN 1 AND gap AND draw > after")
    open_ = open_.withColumn("slice", F.shiftright("draw", DRAW_BITS - SLICE_BITS))
    ahead = Window.partitionBy(*_UNIT).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = open_.groupBy(*_UNIT, "slice", "gap").agg(F.sum("size").alias("words"))
    slices = slices.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    edge = slices.where("before <= gap AND gap < before + words").select(*_UNIT, "slice", "before")
    within = Window.partitionBy(*_UNIT).orderBy("draw").rangeBetween(Window.unboundedPreceding, 0)
    inside = open_.join(edge, [*_UNIT, "slice"]).withColumn("upto", F.col("before") + F.sum("size").over(within))
    beyond = F.col("upto") > F.col("gap")
    borders = inside.groupBy(*_UNIT).agg(F.min(F.when(beyond, F.col("draw"))).alias("border"), F.coalesce(F.max(F.when(~beyond, F.col("upto"))), F.max("before")).alias("upto"))
    totals = slices.groupBy(*_UNIT).agg(F.sum("words").alias("words"))
    return totals.join(borders, _UNIT, "left").select(*_UNIT, "border", F.coalesce("upto", "words").alias("filled"))
