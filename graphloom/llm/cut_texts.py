"""Texts that lost their end to a field limit or a broken transfer.

A backward character n-gram model, trained on values known to be whole, tells for the last characters
of a text how much rather a value goes on after them than ends there. What a score means is learned for each language from
all values known to be whole, at their ends and at every place inside; how often texts of the same source and kind (at its field's limit or not) are cut, and what it
means that other rows show the text whole or longer, is learned from all scores together. The threshold lies where the odds are even.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import bare_id
from graphloom.operators.packed import split_packed
from graphloom.session import cut

#: Characters of context at most: of identifiers, and of labels, where longer ones only know labels by heart.
ORDER, LABEL_ORDER = 12, 8
#: Distinct values whose contexts a task counts at a time.
COUNTED = 20_000
#: Places that a task holds at a time.
PLACES = 200_000
#: What a value's end weighs, and all places inside it together, where the meaning of a score is fitted; whole numbers, so that their sums are the same in every run.
WEIGHT = 1 << 24
#: Values that the shared curve weighs in each language's.
CURVE_VALUES = 200
#: Weight of the shorter context in a longer one's estimate.
BACKOFF = 4.0
#: Scores are kept within this, in bins so wide.
MOST, BIN = 14.0, 0.25
#: What other rows say of a last value; a quote or array that was never closed has lost its end for certain, a closed one below
#: the field's limit has it.
NOTHING, SHOWN, LONGER, OPEN, CLOSED = KINDS = range(5)

MARKS = ("…", "...", "�")


#: Letters that a lower-cased text in Latin letters may have.
LATIN = frozenset(c for x in range(0x250) for c in chr(x).lower())


class Languages:
    """Tells a text's language: its script's name, and in Latin letters the likeliest of `langs` by letter trigrams, whose
    `weights` are the log-rates in each. Without languages all Latin texts are of one."""

    def __init__(self, langs: list[str], weights: dict[str, list[float]]):
        self.langs, self.weights = langs, weights

    def __call__(self, text: str) -> str:
        for ch in text:
            if ord(ch) > 0x24F and ch.isalpha():
                return unicodedata.name(ch, "?").split(" ")[0].lower()
        return self._likeliest(self._added([0.0] * len(self.langs), *_trigrams(text)))

    def beginnings(self, text: str) -> list[str]:
        """The language of text[:1], text[:2] and so on, in one pass."""
        low = text.lower()
        if len(low) != len(text):
            return [self(text[:i]) for i in range(1, len(text) + 1)]
        out, score = [], [0.0] * len(self.langs)
        for i, ch in enumerate(text):
            if ord(ch) > 0x24F and ch.isalpha():
                return out + [unicodedata.name(ch, "?").split(" ")[0].lower()] * (len(text) - i)
            before = low[i - 1] if i else " "
            if i:
                score = self._added(score, (low[i - 2] if i > 1 else " ") + before + low[i])
            out.append(self._likeliest(self._added(score, before + low[i] + " ")))
        return out

    def _added(self, score: list[float], *grams: str) -> list[float]:
        for g in grams:
            if g in self.weights:
                score = [x + w for x, w in zip(score, self.weights[g])]
        return score

    def _likeliest(self, score: list[float]) -> str:
        return self.langs[score.index(max(score))] if self.langs else "latin"


def language_model(values: DataFrame | None) -> Languages:
    """The languages of `values` (value, lang), by the trigrams of all distinct ones. Those that a text in Latin letters may
    have come to the driver, counted."""
    counts: dict[str, Counter] = {}
    if values is not None:
        known = values.filter("value <> '' AND lang IS NOT NULL").select("value", "lang").distinct()
        for r in known.mapInArrow(_gram_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
            counts.setdefault(r["lang"], Counter())[r["gram"]] = r["n"]
    grams = sorted({g for c in counts.values() for g in c})
    langs = sorted(counts)
    totals = [sum(counts[lang].values()) + len(grams) for lang in langs]
    return Languages(langs, {g: [math.log((counts[lang][g] + 1) / n) for lang, n in zip(langs, totals)] for g in grams})


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter((lang, g) for v, lang in zip(batch.column("value").to_pylist(), batch.column("lang").to_pylist()) for g in _trigrams(v))
        rows = [(lang, g, n) for (lang, g), n in found.items() if all(c in LATIN or not c.isalpha() for c in g)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "gram", "n"])


def _trigrams(text: str) -> list[str]:
    t = f" {text.lower()} "
    return [t[i : i + 3] for i in range(len(t) - 2)]


def _hashes(values: list[str], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each context length: the hash of every position of every value, whether it has such a context, and which positions are ends."""
    text = "\x02" + "\x02".join(values) if values else ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(values) else np.zeros(0, np.int64)
    depth = np.arange(len(codes)) - np.repeat(starts, lengths + 1)
    ends = np.zeros(len(codes), dtype=bool)
    ends[np.cumsum(lengths + 1) - 1] = True
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for k in range(1, order + 1):
            n = min(k - 1, len(codes))
            shifted = np.concatenate([np.zeros(n, np.uint64), codes[: len(codes) - n]])
            h = h * np.uint64(6364136223846793005) + shifted + np.uint64(k)
            at = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            # a context may reach one place back over the start; the start itself is no position
            yield k, (at ^ (at >> np.uint64(32))).view(np.int64), depth >= max(1, k - 1), ends


def _count(order: int):
    """Ends and continuations of each context; rows of one context may come several times."""

    def counted(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(part)
        values = rows["value"].to_pylist()
        n = np.repeat(rows["n"].to_numpy(), np.array([len(v) for v in values]) + 1)
        for k, h, ok, ends in _hashes(values, order):
            keys, at = np.unique(h[ok], return_inverse=True)
            e, m = (np.bincount(at, n[ok] * which[ok], len(keys)).astype(np.int64) for which in (ends, ~ends))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys), pa.array(e), pa.array(m)], names=["k", "h", "e", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[pa.RecordBatch] = []
        for batch in batches:
            part.append(batch)
            if sum(b.num_rows for b in part) >= COUNTED:
                yield from counted(part)
                part = []
        if sum(b.num_rows for b in part):
            yield from counted(part)

    return run


@dataclass
class EndModel:
    """Counts of ends and continuations by context, as a table (k, h, e, m), and the rate of ends over all places."""

    counts: DataFrame
    base: float
    order: int
    #: For each language, and '*': the log-odds that each score bin means.
    curves: dict[str, np.ndarray] = field(default_factory=dict)

    def odds(self, texts: DataFrame) -> DataFrame:
        """texts with `score`: log-odds that a value goes on after the last character of `value`, not empty, against that it ends
        there, the rate of ends taken out. `id` must be unique. Where there are columns `own` and `inside`, so many of the
        value's own occurrences are left out of what was counted.

        A context never seen has no row, so that the next shorter one's estimate stands.
        """
        own = "own" in texts.columns
        names = ["id", "value", *(["own", "inside"] if own else [])]
        asked = texts.select(*names).mapInArrow(_asked(self.order, own), "id long, own long, inside boolean, k int, h long")
        hit = asked.join(self.counts, ["k", "h"])
        e = F.greatest(F.col("e") - F.when(F.col("inside"), 0).otherwise(F.col("own")), F.lit(0))
        m = F.greatest(F.col("m") - F.when(F.col("inside"), F.col("own")).otherwise(0), F.lit(0))
        pick = [F.max(F.when(F.col("k") == k, x)).alias(f"{c}{k}") for k in range(1, self.order + 1) for c, x in (("e", e), ("m", m))]
        rates = hit.groupBy("id").agg(*pick)
        rate = F.lit(self.base)
        for k in range(1, self.order + 1):  # columns, not one nested expression, which would double with every step
            rates = rates.withColumn(f"r{k}", F.coalesce((F.col(f"e{k}") + BACKOFF * rate) / (F.col(f"e{k}") + F.col(f"m{k}") + BACKOFF), rate))
            rate = F.col(f"r{k}")
        rate = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
        score = F.log((1 - rate) / rate) - math.log((1 - self.base) / self.base)
        rates = rates.select(F.col("id").alias("__id"), F.least(F.greatest(score, F.lit(-MOST)), F.lit(MOST)).alias("score"))
        return texts.join(rates, F.col("id") == F.col("__id"), "left").drop("__id").withColumn("score", F.coalesce("score", F.lit(0.0)))

    def meaning(self, lang: str, score: str) -> Column:
        """The log-odds of a cut that a score means in a language."""
        at = F.rint(F.col(score) / BIN).cast("int") + int(MOST / BIN) + 1
        out = F.element_at(F.lit(self.curves["*"].tolist()), at)
        for name, curve in self.curves.items():
            if name != "*":
                out = F.when(F.col(lang) == name, F.element_at(F.lit(curve.tolist()), at)).otherwise(out)
        return out


def _asked(order: int, own: bool):
    """The contexts of each text's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            left, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "inside")) if own else (np.zeros(len(ids), np.int64), np.zeros(len(ids), bool))
            for k, h, ok, ends in _hashes(batch.column("value").to_pylist(), order):
                has = ok[ends]
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(left[has]), pa.array(inside[has]), pa.array(np.full(has.sum(), k, np.int32)), pa.array(h[ends][has])], names=["id", "own", "inside", "k", "h"])

    return run


def _curve(ends: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Log-odds of a cut for each score bin, never falling: neighbouring bins that would fall are pooled."""
    e, c = ends.sum() + 1.0, inside.sum() + 1.0
    pools: list[list[float]] = []  # end, inside, bins
    for x, y in zip(ends, inside):
        pools.append([float(x), float(y), 1])
        while len(pools) > 1 and (pools[-2][1] + 0.5) * (pools[-1][0] + 0.5) >= (pools[-1][1] + 0.5) * (pools[-2][0] + 0.5):
            last = pools.pop()
            pools[-1] = [pools[-1][i] + last[i] for i in range(3)]
    return np.array([math.log((p[1] + 0.5) / c) - math.log((p[0] + 0.5) / e) for p in pools for _ in range(int(p[2]))])


def _tagged(tag: Callable[[str], str]):
    """Texts with their language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pa.array([tag(v) for v in batch.column("value").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("n"), langs], names=["value", "n", "lang"])

    return run


def _places(tag: Callable[[str], str], order: int):
    """Every place of whole values: the characters before it that a score looks at, the language of all that is before it,
    whether the value goes on (`inside`), and its weight; rows of one kind may come several times."""
    beginnings = getattr(tag, "beginnings", None) or (lambda v: [tag(v[:i]) for i in range(1, len(v) + 1)])

    def rows(found: dict[tuple[str, str, bool], int]) -> pa.RecordBatch:
        columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(found.values(), pa.int64())], names=["value", "lang", "inside", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str, bool], int] = {}
        for batch in batches:
            for v, n in zip(batch.column("value").to_pylist(), batch.column("n").to_pylist()):
                share = n * WEIGHT // max(1, len(v) - 1)
                for i, lang in enumerate(beginnings(v), 1):
                    at = (v[max(0, i - order) : i], lang, i < len(v))
                    found[at] = found.get(at, 0) + (share if i < len(v) else n * WEIGHT)
                if len(found) >= PLACES:
                    yield rows(found)
                    found = {}
        if found:
            yield rows(found)

    return run


def train(values: DataFrame, tag: Callable[[str], str], order: int = ORDER) -> EndModel:
    """The model of the rows of `value`, its curves still missing (see `judge`)."""
    known = cut(values.filter("value <> ''").groupBy("value").agg(F.count("*").alias("n")))
    total = known.agg(F.sum("n").alias("e"), F.sum(F.char_length("value") * F.col("n")).alias("places")).first()
    counts = known.mapInArrow(_count(order), "k int, h long, e long, m long").groupBy("k", "h").agg(F.sum("e").alias("e"), F.sum("m").alias("m"))
    model = EndModel(counts, ((total["e"] or 0) + 0.5) / ((total["places"] or 0) + 10.0), order)
    model.labelled = known.mapInArrow(_places(tag, order), "value string, lang string, inside boolean, n long").groupBy("value", "lang", "inside").agg(F.sum("n").alias("n"))
    return model


def _scored(model: EndModel, values: DataFrame, tag: Callable[[str], str]) -> DataFrame:
    """(value, lang, n, llr) of the distinct non-empty values, and the model's curves from its labelled places, scored with them.

    The labelled places' scores, each leaving one occurrence out, tell what a score means: histograms of a hundred
    bins a language come to the driver.
    """
    asked = values.filter("value <> ''").groupBy("value").agg(F.count("*").alias("n")).mapInArrow(_tagged(tag), "value string, n long, lang string")
    asked = asked.withColumns({"own": F.lit(0).cast("long"), "inside": F.lit(False)}).unionByName(model.labelled.withColumn("own", F.lit(1).cast("long")))
    rows = cut(model.odds(cut(asked.withColumn("id", F.monotonically_increasing_id()))))
    size = 2 * int(MOST / BIN) + 1
    bins: dict[str, np.ndarray] = {"*": np.zeros((2, size))}
    for r in rows.filter("own > 0").groupBy("lang", "inside", F.rint(F.col("score") / BIN).cast("int").alias("b")).agg(F.sum("n").alias("n")).collect():
        for lang in (r["lang"], "*"):
            bins.setdefault(lang, np.zeros((2, size)))[int(r["inside"]), r["b"] + size // 2] += r["n"] / WEIGHT
    shared = bins["*"] / np.maximum(1, bins["*"].sum(axis=1, keepdims=True))
    model.curves = {x: _curve(*(b if x == "*" else b + CURVE_VALUES * shared)) for x, b in bins.items()}
    return rows.filter("own = 0").select("value", "lang", "n", model.meaning("lang", "score").alias("llr"))


def field_limits(df: DataFrame, source: str, text: str) -> list[tuple[str | None, str, int, float]]:
    """(source, unit, limit, share cut): lengths, in characters or bytes, at which a source's texts pile up and that
    none passes but by a mark for what was left out. As many texts as have each length just below are whole
    at the limit, too. Three rows a source and unit come to the driver."""
    sizes = df.filter(F.col(text).isNotNull()).select(F.col(source).alias("s"), F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.char_length(text).alias("n")), F.struct(F.lit("bytes").alias("unit"), F.octet_length(text).alias("n")))).alias("x"))
    lengths = sizes.groupBy("s", "x.unit", "x.n").count()
    tops = lengths.groupBy(F.col("s").alias("t"), F.col("unit").alias("u")).agg(F.max("n").alias("top"))
    # none passes a limit by more than a mark's two extra characters, so the longest lengths alone may be limits
    near = lengths.join(F.broadcast(tops), F.col("s").eqNullSafe(F.col("t")) & (F.col("unit") == F.col("u"))).withColumn("c", F.explode(F.sequence(F.greatest(F.col("top") - 2, F.lit(1)), F.greatest(F.col("top"), F.lit(1)))))
    each = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0))
    piles = near.groupBy("s", "unit", "c").agg(each(F.col("n") == F.col("c")).alias("at"), each((F.col("n") >= F.col("c") * 0.9) & (F.col("n") < F.col("c"))).alias("below"), each(F.col("n") >= F.col("c")).alias("from_here"))
    found: dict[str | None, tuple[int, str, int, float]] = {}
    for r in piles.filter("at >= 2").orderBy("unit", "c").collect():
        usual = r["below"] / max(1.0, r["c"] * 0.1)
        if r["at"] > 5 * usual and (r["s"] not in found or r["at"] > found[r["s"]][0]):
            found[r["s"]] = (r["at"], r["unit"], r["c"], 1 - min(0.5, max(usual, 0.2) / r["from_here"]))
    return [(s, unit, n, share) for s, (_, unit, n, share) in found.items()]


def at_limit(limits: list[tuple[str | None, str, int, float]], source: str, text: str) -> Column:
    out = F.lit(False)
    for s, unit, n, _ in limits:
        size = F.char_length(text) if unit == "chars" else F.octet_length(text)
        out = F.when(F.col(source).eqNullSafe(F.lit(s)), size >= n).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _rates(cells: list[tuple[str | None, bool, float, int, int]], limits: list[tuple[str | None, str, int, float]], rounds: int = 200) -> tuple[dict[tuple, float], dict[tuple[bool, int], float]]:
    """Log-odds that a text is cut by (source, at limit), and what each kind of evidence adds by (at limit, kind), from
    cells (source, at limit, log-odds of the score, evidence, count).

    Expectation-maximisation: a text is cut or not; score and evidence follow from that alone. At a limit the pile
    of lengths tells how many are cut; open texts are, closed ones aren't.
    """
    pile = {s: share for s, _, _, share in limits}
    groups = sorted({(c[0], c[1]) for c in cells}, key=str)
    g = np.array([groups.index((c[0], c[1])) for c in cells])
    full, llr, kind, n = (np.array([c[i] for c in cells]) for i in (1, 2, 3, 4))
    fixed = np.array([pile.get(s, 0.5) if f else -1.0 for s, f in groups])
    rate = np.where(fixed >= 0, fixed, 0.02)
    side = full.astype(int)
    extra = np.zeros((2, len(KINDS)))
    total = np.bincount(g, n, len(groups))
    for _ in range(rounds):
        odds = np.log(rate / (1 - rate))[g] + llr + extra[side, kind]
        post = np.where(kind == OPEN, n, np.where(kind == CLOSED, 0, n / (1 + np.exp(-np.clip(odds, -60, 60)))))
        got = np.bincount(g, post, len(groups)) / total
        rate = np.where(fixed >= 0, fixed, np.clip(got, 1e-4, 0.5))
        whole = np.bincount(kind, n - post, len(KINDS)) + 0.5
        for f in (0, 1):
            is_cut = np.bincount(kind[side == f], post[side == f], len(KINDS)) + 0.5
            whole[CLOSED] = 0.5 if f else whole[CLOSED]  # at the limit there is no such kind
            extra[f] = np.log(is_cut / is_cut.sum()) - np.log(whole / whole.sum())
    return {k: math.log(r / (1 - r)) for k, r in zip(groups, rate)}, {(bool(f), k): extra[f, k] for f in (0, 1) for k in KINDS}


def _decided(ends: DataFrame, limits: list) -> DataFrame:
    """ends (source, at_limit, llr, evidence) with `odds`. Comes to the driver: a histogram of a hundred bins for each source."""
    bins = ends.groupBy("source", "at_limit", "evidence", F.rint(F.col("llr") / BIN).cast("int").alias("b")).count().collect()
    if not bins:
        return ends.withColumn("odds", F.lit(0.0))
    priors, extras = _rates([(r["source"], r["at_limit"], r["b"] * BIN, r["evidence"], r["count"]) for r in bins], limits)
    prior, extra = F.lit(0.0), F.lit(0.0)
    for (s, full), w in priors.items():
        prior = F.when(F.col("source").eqNullSafe(F.lit(s)) & (F.col("at_limit") == F.lit(full)), F.lit(w)).otherwise(prior)
    for (full, k), w in extras.items():
        extra = F.when((F.col("evidence") == k) & (F.col("at_limit") == F.lit(full)), F.lit(float(w))).otherwise(extra)
    return ends.withColumn("odds", F.col("llr") + prior + extra)


def evidence(labels: DataFrame) -> DataFrame:
    """(key, evidence) of the last labels for which other rows of the same entity say something.

    labels: key, entity, text_id, at_limit, value, is_last, is_open; all of a row's. What is certain are labels of rows that
    are neither open nor at the limit. SHOWN: another row has the label in a place where it is whole, and a row at the
    limit lacks none of the entity's labels; LONGER: another row has one that only begins with it.

    Each entity's labels are cut to the lengths that its last labels have and then met by equality, so that no
    entity's rows are compared all with all.
    """
    known = labels.filter("entity IS NOT NULL")
    sure = known.filter("NOT at_limit AND NOT is_open").groupBy("entity", "value").agg(F.count("*").alias("n"), F.sum(F.col("is_last").cast("int")).alias("n_last"), F.min("key").alias("lo"), F.max("key").alias("hi"), (F.min("text_id") != F.max("text_id")).alias("in_two"))
    # repeated rows were cut alike: only a place before the end, or the end of two different texts, shows a label whole
    sure = cut(sure.withColumn("shown", (F.col("n") > F.col("n_last")) | F.col("in_two")))
    ends = known.filter("is_last").select("key", "entity", "value", "at_limit")
    lengths = ends.groupBy(F.col("entity").alias("e")).agg(F.collect_set(F.char_length("value")).alias("lengths"))
    begun = sure.join(lengths, F.col("entity") == F.col("e")).withColumn("size", F.char_length("value"))
    begun = begun.withColumn("l", F.explode(F.filter("lengths", lambda x: x <= F.col("size")))).select("entity", F.expr("substring(value, 1, l)").alias("begin"), (F.col("l") == F.col("size")).alias("same"), "shown", "lo", "hi")
    same = lambda x, f: f(F.when(F.col("same"), F.col(x)))
    more = lambda x, f: f(F.when(~F.col("same"), F.col(x)))
    begun = begun.groupBy(F.col("entity").alias("e"), "begin").agg(F.coalesce(F.bool_or(F.col("same") & F.col("shown")), F.lit(False)).alias("shown"), same("lo", F.min).alias("lo"), same("hi", F.max).alias("hi"), more("lo", F.min).alias("from"), more("hi", F.max).alias("to"))
    met = ends.join(begun, (F.col("entity") == F.col("e")) & (F.col("value") == F.col("begin")))
    # a row vouches for its own last label only through another row
    met = met.select("key", (F.col("shown") & ((F.col("lo") != F.col("key")) | (F.col("hi") != F.col("key")))).alias("shown"), ((F.col("from") != F.col("key")) | (F.col("to") != F.col("key"))).alias("longer"))
    theirs = sure.groupBy(F.col("entity").alias("e")).agg(F.count("*").alias("theirs"))
    mine = known.filter("at_limit").select("key", "entity", "value").distinct().join(sure.select(F.col("entity").alias("e"), F.col("value").alias("v")), (F.col("entity") == F.col("e")) & (F.col("value") == F.col("v"))).groupBy("key").agg(F.count("*").alias("mine"))
    lacking = ends.filter("at_limit").join(theirs, F.col("entity") == F.col("e")).join(mine.withColumnRenamed("key", "mk"), F.col("key") == F.col("mk"), "left")
    lacking = lacking.filter(F.coalesce("mine", F.lit(0)) < F.col("theirs")).select(F.col("key").alias("lk"), F.lit(True).alias("lacks"))
    both = met.join(lacking, F.col("key") == F.col("lk"), "left")
    kind = F.when(F.col("shown") & F.col("lacks").isNull(), SHOWN).when(F.col("longer") & ~F.col("shown"), LONGER).otherwise(NOTHING)
    return both.select("key", kind.alias("evidence")).filter(F.col("evidence") != NOTHING)


def _closing(text: str) -> Column:
    """How many marks that close a quote or an array a text ends with; the value inside has fewer."""
    return F.char_length(F.rtrim(text, F.lit(" \t\r\n"))) - F.char_length(F.rtrim(text, F.lit('"] \t\r\n')))


def cut_lists(df: DataFrame, key: str, text: str, source: str, entity: str, cut_ids: DataFrame | None = None, languages: DataFrame | None = None) -> DataFrame:
    """The keys of rows whose packed list of labels `text` was stored without its end.

    The last label is what may be cut. The model learns from labels that others follow, which are whole. To its odds
    comes what rows of the same `entity` show (see evidence), weighed as all scores together tell; rows in `cut_ids` (key)
    have no usable entity. `languages` (value, lang) are labelled values that tell the languages apart. Null, empty and
    blank texts are no case. Repeated rows are judged alike.
    """
    limits = field_limits(df, source, text)
    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), F.xxhash64(text).alias("text_id"), at_limit(limits, source, text).alias("at_limit"), bare_id(entity).alias("entity"), _closing(text).alias("closing"))
    if cut_ids is not None:
        rows = rows.join(cut_ids.select(F.col(key).alias("ck"), F.lit(True).alias("off")), F.col("key") == F.col("ck"), "left").withColumn("entity", F.when(F.col("off").isNull(), F.col("entity"))).drop("ck", "off")
    split = split_packed(df, key, text).select(F.col(key).alias("k"), F.col("label_value").alias("value"), "is_last", "is_open")
    labels = cut(split.join(rows, F.col("k") == F.col("key")).drop("k"))
    tag = language_model(languages)
    model = train(labels.filter("NOT is_last").select("value"), tag, LABEL_ORDER)
    ends = labels.filter("is_last").select("key", "source", "at_limit", "value", "is_open", (~F.col("is_open") & ~F.col("at_limit") & (F.col("closing") > _closing("value"))).alias("is_closed"))
    # at the limit a mark for what was left out isn't part of the value
    last = "(" + "|".join(re.escape(x) for x in MARKS) + r")\z"
    ends = ends.withColumn("value", F.when(F.col("at_limit"), F.regexp_replace("value", last, "")).otherwise(F.col("value")))
    scores = _scored(model, ends, tag).select(F.col("value").alias("v"), "llr")
    scored = ends.join(scores, F.col("value") == F.col("v"), "left").drop("v").withColumn("llr", F.coalesce("llr", F.lit(MOST)))  # nothing but a mark is left
    shown = evidence(labels).withColumnRenamed("key", "sk")
    judged = scored.join(shown, F.col("key") == F.col("sk"), "left").withColumn("evidence", F.when(F.col("is_open"), OPEN).when(F.col("is_closed"), CLOSED).otherwise(F.coalesce("evidence", F.lit(NOTHING))))
    return _decided(cut(judged.select("key", "source", "at_limit", "llr", "evidence")), limits).filter((F.col("odds") > 0) & (F.col("evidence") != CLOSED) | (F.col("evidence") == OPEN)).select(F.col("key").alias(key))


def cut_codes(df: DataFrame, key: str, code: str) -> DataFrame:
    """The keys of rows whose identifier `code` was stored without its end.

    Identifiers are read in their bare form; behind their first three characters a digit counts as any digit, so
    that the model learns how long the identifiers of each range are. It learns from those below the field's limit,
    which is one for all sources; where none are shorter nothing is known and nothing is a case. Null and empty
    identifiers are no case.
    """
    bare = bare_id(code)
    shape = F.concat(F.substring(bare, 1, 3), F.regexp_replace(F.substring(bare, 4, 64), "[0-9]", "0"))
    rows = df.filter(bare.isNotNull()).select(F.col(key).alias("key"), F.lit("").alias("source"), F.col(code).alias("code"), shape.alias("value"))
    limits = field_limits(rows, "source", "code")
    rows = rows.withColumn("at_limit", at_limit(limits, "source", "code"))
    model = train(rows.filter("NOT at_limit").select("value"), _no_language)
    scores = _scored(model, rows, _no_language).select(F.col("value").alias("v"), "llr")
    ends = rows.join(scores, F.col("value") == F.col("v")).select("key", "source", "at_limit", "llr", F.lit(NOTHING).alias("evidence"))
    return _decided(ends, limits).filter("odds > 0 AND llr > 0").select(F.col("key").alias(key))


def _no_language(text: str) -> str:
    return "id"
