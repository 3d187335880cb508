"""Sources mixed to target shares, small ones repeated within limits, texts that several sources have used once.

Texts are grouped by the set of sources that have them. A min-cost flow from the sources' quotas over these patterns,
each repetition dearer than the one before, says how much of a pattern each source takes; texts are then
laid out in seeded order and the flow's stretches cut from that line, each cut filled up with texts that fit.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import ordered_position, prefix_sum
from graphloom.session import cut

#: So many texts of mean size behind a stretch's end are looked at to fill it exactly.
REACH = 64
#: Rows that one task sorts, from which the number of sub-groups of a line follows.
TASK_ROWS = 20_000


class Flow:
    """Min-cost flow by successive shortest paths, in whole numbers."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        total, n = 0, len(self.out)
        while True:
            dist: list[int | None] = [None] * n
            via, queued = [-1] * n, [False] * n
            dist[source], queue = 0, deque([source])
            while queue:
                x = queue.popleft()
                queued[x] = False
                for e in self.out[x]:
                    d = dist[x] + self.cost[e]
                    y = self.to[e]
                    if self.room[e] and (dist[y] is None or d < dist[y]):
                        dist[y], via[y] = d, e
                        if not queued[y]:
                            queued[y] = True
                            queue.append(y)
            if dist[sink] is None:
                return total
            push, y = None, sink
            while y != source:
                push = self.room[via[y]] if push is None else min(push, self.room[via[y]])
                y = self.to[via[y] ^ 1]
            y = sink
            while y != source:
                self.room[via[y]] -= push
                self.room[via[y] ^ 1] += push
                y = self.to[via[y] ^ 1]
            total += push


def route(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """(size, {(pattern, source): size taken}).

    Without `total` the largest mixture that meets all shares. With it a mixture of that size, as nearly as whole
    numbers allow: sources that can give their share do so, scarce ones give all they have and are made up for by the others in
    proportion; where all of them together have less, all is taken. Sources without any text get nothing.
    """
    there = sorted({s for p, n in patterns.items() if n for s in p if shares.get(s, 0) > 0 and repeats[s] > 0})
    weight = {s: Fraction(shares[s]).limit_denominator(10**9) for s in there}
    whole = sum(weight.values())
    names = sorted(p for p, n in patterns.items() if n and set(p) & set(there))
    if not there:
        return 0, {}

    def solve(size: int) -> tuple[int, bool, dict]:
        quotas = {s: int(size * weight[s] / whole) for s in there}
        g = Flow(2 + len(there) + len(names))
        for i, s in enumerate(there):
            g.arc(0, 2 + i, quotas[s])
        arcs = {}
        for k, p in enumerate(names):
            node = 2 + len(there) + k
            own = [s for s in p if s in weight]
            for s in own:
                arcs[p, s] = g.arc(2 + there.index(s), node, patterns[p] * repeats[s])
            for r in range(max(repeats[s] for s in own)):
                g.arc(node, 1, patterns[p], r * r)
        size = g.run(0, 1)
        return size, size == sum(quotas.values()), {k: g.room[e ^ 1] for k, e in arcs.items() if g.room[e ^ 1]}

    most = {s: sum(n * repeats[s] for p, n in patterns.items() if s in p) for s in there}
    if total is None:
        low, high = 0, sum(most.values())
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if solve(mid)[1] else (low, mid - 1)
        return low, solve(low)[2]
    # the least size to aim at whose flow is the total
    low, high = 0, max(int(most[s] * whole / weight[s]) + 1 for s in there)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if solve(mid)[0] >= total else (mid + 1, high)
    size, _, taken = solve(low)
    return size, taken


def _filled(rows: list[tuple[int, int, int]], bounds: list[int], reach: int) -> dict[int, int]:
    """New places of texts (place, size, id), given in order, so that the bounds fall between texts as nearly as these allow."""
    at = {i: before for before, _, i in rows}
    size = {i: n for _, n, i in rows}
    moved: dict[int, int] = {}
    for b in sorted(bounds):
        run = sorted((i for i in at if at[i] + size[i] > b and at[i] < b + reach), key=lambda i: (at[i], i))
        if not run or at[run[0]] >= b:
            continue
        start = at[run[0]]
        gap, taken = b - start, []
        for i in run:
            if size[i] <= gap:
                gap -= size[i]
                taken.append(i)
        if gap < min(b - start, start + size[run[0]] - b):
            chosen = set(taken)
            for i in taken + [i for i in run if i not in chosen]:
                moved[i] = at[i] = start
                start += size[i]
    return moved


def mix(docs: DataFrame, key: str, text_id: str, source: str, size: str, weights: DataFrame, seed: int = 0, total: int | None = None) -> DataFrame:
    """(key, src_name, use_no, n_tokens): the drawn documents, one row a use, use_no from 1.

    Each source of `weights` (src_name, target_share, max_repeats) gets its share of all drawn size as nearly as whole
    documents allow. Without `total` the draw is the largest in which all sources that have documents get their
    shares of what those make up together; with it the draw is that large, and sources that can't give their share within max_repeats
    give all they have, the others keeping their proportions. Documents with the same text_id in several sources are
    one text that those share, copies in one source are so many texts; no document is used for a source more than
    its max_repeats times. Documents without source, of a source without weight or of no size aren't drawn; a source without
    documents gets nothing. The same seed draws the same documents.

    Comes to the driver: one row for each set of sources that share a text, and some REACH texts for each end of a stretch.
    """
    rows = [(r["src_name"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in weights.select("src_name", "target_share", "max_repeats").collect() if r["src_name"] is not None]
    shares, repeats = {s: w for s, w, _ in rows}, {s: m for s, _, m in rows}
    usable = docs.filter(F.col(source).isin(list(shares)) & (F.col(size) > 0)).select(F.col(key).alias("key"), F.col(text_id).alias("text_id"), F.col(source).alias("src"), F.col(size).cast("long").alias("n"))
    # the n-th copies of a text in all its sources are one text; a hot text's copies are numbered in 256 runs
    usable = ordered_position(usable.withColumn("__o", F.pmod(F.xxhash64("key"), F.lit(1 << 20))), ["text_id", "src"], "__o", ["key"], "copy").drop("__o")
    texts = usable.groupBy("text_id", "copy").agg(F.sort_array(F.collect_list(F.struct("src", "key"))).alias("by"), F.max("n").alias("n"))
    texts = texts.withColumn("pattern", F.array_join(F.transform("by", lambda x: x["src"]), "\x1f")).withColumn("h", F.xxhash64("text_id", "copy", F.lit(seed)))
    texts = cut(texts)
    found = texts.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    patterns = {tuple(r["pattern"].split("\x1f")): r["n"] for r in found}
    most = max((r["texts"] for r in found), default=1)
    _, taken = route(patterns, shares, repeats, total)
    stretches, ends = [], {}
    for (p, s), x in sorted(taken.items()):
        stretches.append(("\x1f".join(p), s, ends.get(p, 0), ends.get(p, 0) + x, patterns[p]))
        ends[p] = ends.get(p, 0) + x
    spark = docs.sparkSession
    plan = spark.createDataFrame(stretches, "p string, src_name string, lo long, hi long, line long")
    line = prefix_sum(texts, ["pattern"], ["h", "text_id", "copy"], "n", "before", max(1, min(4096, -(-most // TASK_ROWS))))
    bounds: dict[str, set[int]] = {}
    for p, _, _, hi, whole in stretches:
        if hi % whole:
            bounds.setdefault(p, set()).add(hi % whole)
    if bounds:
        line = cut(line)
        reach = {r["pattern"]: REACH * max(1, r["n"] // r["texts"]) for r in found}
        marks = spark.createDataFrame([(p, b, b + reach[p]) for p, bs in bounds.items() for b in bs], "p string, b long, upto long")
        near = line.join(F.broadcast(marks), (F.col("pattern") == F.col("p")) & (F.col("before") + F.col("n") > F.col("b")) & (F.col("before") < F.col("upto")))
        near = near.select("pattern", "before", "n", "text_id", "copy").distinct().collect()
        moved = []
        for p, bs in bounds.items():
            run = [r for r in near if r["pattern"] == p]
            new = _filled([(r["before"], r["n"], i) for i, r in enumerate(run)], sorted(bs), reach[p])
            moved += [(run[i]["text_id"], run[i]["copy"], at) for i, at in new.items()]
        if moved:
            kind = dict(texts.dtypes)["text_id"]
            places = spark.createDataFrame(moved, f"__t {kind}, __c long, __at long")
            line = line.join(F.broadcast(places), F.col("text_id").eqNullSafe(F.col("__t")) & (F.col("copy") == F.col("__c")), "left").withColumn("before", F.coalesce("__at", "before"))
    line = line.withColumn("mid", F.col("before") + F.floor(F.col("n") / 2))
    # one row for each set of sources and source: as bounded as the patterns
    drawn = line.join(F.broadcast(plan), F.col("pattern") == F.col("p"))
    first = F.greatest(F.lit(0), F.ceil((F.col("lo") - F.col("mid")) / F.col("line"))).cast("int")
    after = F.ceil((F.col("hi") - F.col("mid")) / F.col("line")).cast("int")
    drawn = drawn.withColumns({"first": first, "after": after}).filter("after > first")
    own = F.get(F.filter("by", lambda x: x["src"] == F.col("src_name")), F.lit(0))["key"]
    return drawn.select(own.alias(key), "src_name", F.explode(F.sequence(F.lit(1), F.col("after") - F.col("first"))).alias("use_no"), F.col("n").alias("n_tokens"))
