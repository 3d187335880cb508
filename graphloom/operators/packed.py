"""Several values packed in one field, with delimiters that differ from row to row.

Quoted spans, escaped marks and JSON arrays are atomic. Elsewhere every mark that may separate is a site of
a lattice whose arcs are possible values. Expectation-maximisation over the whole column learns how often each
value occurs and how often each kind of site separates; the Viterbi path through a row's lattice is its split.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.nested import dumps, loads, strings
from graphloom.session import cut, drop

#: Marks that separate wherever they stand outside quotes; a bare slash or a comma has to earn it.
STRONG = ";；|•\t\n\r"
KINDS = (",", "/")
#: How often a bare slash and a comma separate before anything is seen, and how many sites that view weighs.
PRIOR, PRIOR_SITES = {",": 0.9, "/": 0.05}, 50
#: Expectation-maximisation goes on until the likelihood of a site changes by less than this (in log), or so many rounds.
SETTLED, ROUNDS = 1e-3, 50
#: Characters a label is made of, for the probability of one never seen.
LETTERS = 28

_STRONG_RUN = re.compile(f"[{re.escape(STRONG)}]")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        e = m.group(1)
        return chr(int(e[1:], 16)) if len(e) == 5 else _PLAIN.get(e, e)

    return _ESCAPE.sub(one, text).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _json_array(text: str) -> tuple[list[str], bool] | None:
    """The texts of a JSON array and whether it was cut short; None if it is none."""
    if not text.startswith("["):
        return None
    try:
        got = loads(text)
        return [x if isinstance(x, str) else dumps(x) for x in got if x is not None], False
    except ValueError:
        pass
    out, at, n = [], 1, len(text)
    while at < n and text[at] in " \t\r\n,":
        at += 1
    while at < n:
        if text[at] != '"':
            return None
        end = at + 1
        while end < n and text[end] != '"':
            end += 2 if text[end] == "\\" else 1
        body = text[at + 1 : end]
        if end >= n:  # an escape without its rest goes too
            body = re.sub(r"(?<!\\)((?:\\\\)*)\\(u[0-9a-fA-F]{0,3})?$", r"\1", body)
        out.append(_unescape(body))
        at = end + 1
        while at < n and text[at] in " \t\r\n,":
            at += 1
    return (out, True) if out else None


def _quote(text: str, at: int) -> tuple[str, int, bool] | None:
    """The quoted span that opens at `at`: value, where it ends, whether it was closed. None: a mark like any other."""
    n, i = len(text), at + 1
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n and text[i + 1] in '"\\':
            i += 2
        elif c == '"' and i + 1 < n and text[i + 1] == '"':
            i += 2
        elif c == '"':
            break
        else:
            i += 1
    body = re.sub(r'\\(["\\])', r"\1", text[at + 1 : min(i, n)].replace('""', '"'))
    if i >= n:
        return re.sub(r"\\$", "", body).strip(), n, False
    j = i + 1
    while j < n and text[j].isspace() and text[j] not in STRONG:
        j += 1
    return (body.strip(), i + 1, True) if j >= n or text[j] in STRONG or text[j] in KINDS else None


def blocks(text: str) -> tuple[list[tuple[list[str], list[str]]], bool]:
    """The lattices of a text in stored order, and whether its end is open (a quote or array isn't closed).

    A lattice is (parts, gaps): the text of a gap stands between two parts and may separate them. One without
    gaps is a value for certain. Blanks around values are gone, empty values too.
    """
    if not ("," in text or "/" in text or '"' in text or "\\" in text or "[" in text):
        return [([v.strip()], []) for v in _STRONG_RUN.split(text) if v.strip()], False
    got = _json_array(text.strip())
    if got is not None:
        return [([v.strip()], []) for v in got[0] if v.strip()], got[1]
    parts: list[tuple[str, bool, int, int, str]] = []  # value, atomic, start, end, mark after it
    at = start = 0
    n, fresh, atom, is_open = len(text), True, None, False
    while at <= n:
        c = text[at] if at < n else ""
        if c == '"' and fresh and (q := _quote(text, at)):
            atom, at, closed = q
            is_open = not closed
            fresh = False
            continue
        if c == "\\":
            fresh, at = False, min(at + 2, n)
            continue
        slash = c == "/" and 0 < at < n - 1 and text[at - 1].isspace() and text[at + 1].isspace()
        if c == "" or c in STRONG or c in KINDS:
            raw = text[start:min(at, n)]
            parts.append((re.sub(r"\\(.?)", r"\1", raw, flags=re.S).strip() if atom is None else atom, atom is not None, start, min(at, n), " / " if slash else c))
            start, fresh, atom = at + 1, True, None
        elif not c.isspace():
            fresh = False
        at += 1
    strong = any(m and (m in STRONG or m == " / ") for *_, m in parts)
    out: list[tuple[list[str], list[str]]] = []
    now: tuple[list[str], list[str]] = ([], [])
    glue = None  # the gap that a comma which can't separate leaves

    def end_block() -> None:
        nonlocal now
        if now[0]:
            out.append(now)
        now = ([], [])

    for k, (value, atomic, s, e, mark) in enumerate(parts):
        if glue is not None and now[0]:
            now[0][-1] = (now[0][-1] + glue + value).strip()
        elif value:
            now[0].append(value)
        glue = None
        hard = mark == "" or mark in STRONG or mark == " / " or atomic or not value or (k + 1 < len(parts) and (parts[k + 1][1] or not parts[k + 1][0]))
        if not hard or (mark == "," and strong and not atomic and value and not (k + 1 < len(parts) and parts[k + 1][1])):
            # the gap keeps its blanks
            right = parts[k + 1]
            lead = text[right[2] : right[3]]
            gap = text[s:e][len(text[s:e].rstrip()) :] + mark + lead[: len(lead) - len(lead.lstrip())]
            if mark == "," and strong:
                glue = gap
            else:
                now[1].append(gap)
        else:
            end_block()
    end_block()
    return out, is_open


def _value(parts: list[str], gaps: list[str], i: int, j: int) -> str:
    return "".join(p + g for p, g in zip(parts[i : j - 1], gaps[i : j - 1])) + parts[j - 1]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


class Lattice:
    """The log weights of one lattice: parts with what they are worth as values, sites that separate or not, and
    values known to hold sites. A new value of any length is put together from its parts and sites."""

    def __init__(self, arcs: list[dict], total: float, new: float, rates: dict) -> None:
        single = sorted((x for x in arcs if x["j"] == x["i"] + 1), key=lambda x: x["i"])
        self.arcs = single
        self.n = n = len(single)
        unseen = [-(len(x["label_value"]) + 1) * math.log(LETTERS) for x in single]
        self.single = [math.log((1 - new) * max(x["c"], 0.0) / total + new * math.exp(max(-700, u)) + 1e-300) for x, u in zip(single, unseen)]
        self.marks = [x["gap"].strip() for x in single[:-1]]
        self.cuts = [math.log(rates[m]) for m in self.marks] + [0.0]
        self.keeps = [math.log(1 - rates[m]) for m in self.marks]
        self.ends: list[list[tuple[int, float, dict]]] = [[] for _ in range(n + 1)]
        self.begins: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for x in arcs:
            i, j = x["i"], x["j"]
            if j - i > 1 and x["c"] > 1e-6:
                w = math.log((1 - new) * x["c"] / total) + sum(self.keeps[i : j - 1]) + self.cuts[j - 1]
                self.ends[j].append((i, w, x))
                self.begins[i].append((j, w))

    def posterior(self) -> tuple[float, list[float], list[float]]:
        """The log likelihood, how surely each part is a value of its own, and each site separates."""
        n, none = self.n, -math.inf
        ahead, inside = [0.0] + [none] * n, [none] * (n + 1)
        for j in range(1, n + 1):
            inside[j] = self.single[j - 1] + (_add(ahead[j - 1], inside[j - 1] + self.keeps[j - 2]) if j > 1 else 0.0)
            ahead[j] = inside[j] + self.cuts[j - 1]
            for i, w, _ in self.ends[j]:
                ahead[j] = _add(ahead[j], ahead[i] + w)
        back, later = [none] * n + [0.0], [none] * n + [0.0]
        for j in range(n - 1, -1, -1):
            back[j] = self.single[j] + later[j + 1]
            for e, w in self.begins[j]:
                back[j] = _add(back[j], w + back[e])
            if j:
                later[j] = _add(self.cuts[j - 1] + back[j], self.keeps[j - 1] + self.single[j] + later[j + 1])
        whole = ahead[n]
        own = [math.exp(min(0.0, ahead[i] + self.single[i] + self.cuts[i] + back[i + 1] - whole)) for i in range(n)]
        return whole, own, [math.exp(min(0.0, ahead[j] + back[j] - whole)) for j in range(1, n)]

    def best(self) -> list[tuple[int, int]]:
        """The likeliest values, as (first part, end)."""
        n, none = self.n, -math.inf
        cut_at: list[tuple[float, int]] = [(0.0, 0)] + [(none, 0)] * n
        inside: list[tuple[float, int]] = [(none, 0)] * (n + 1)  # weight, where the value began
        for j in range(1, n + 1):
            inside[j] = (cut_at[j - 1][0] + self.single[j - 1], j - 1)
            if j > 1:
                on = inside[j - 1][0] + self.keeps[j - 2] + self.single[j - 1]
                inside[j] = max(inside[j], (on, inside[j - 1][1]))
            cut_at[j] = max([(inside[j][0] + self.cuts[j - 1], inside[j][1]), *((cut_at[i][0] + w, i) for i, w, _ in self.ends[j])])
        path, j = [], n
        while j:
            path.append((cut_at[j][1], j))
            j = cut_at[j][1]
        return path[::-1]

    def value(self, i: int, j: int) -> str:
        return "".join(x["label_value"] + x["gap"] for x in self.arcs[i : j - 1]) + self.arcs[j - 1]["label_value"]


def _is(mark: str):
    return lambda gap: F.trim(gap) == mark


def split_packed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, label_value, is_last, is_open): one row per value packed in `text`, pos from 0 in stored order.

    `key` must be unique. Values come without enclosing quotes, escapes and surrounding blanks; empty ones
    take no position. A null, empty or blank text gives no row. is_last marks a row's last value, is_open
    one whose quote or array was never closed, so that only what is left of it was stored.

    The column's value counts stay a table that is joined to the arcs, as they grow with the data; only the
    rates of the kinds of site and the totals come to the driver.
    """
    schema = "k long, blk int, many boolean, parts array<string>, gaps array<string>, atomic boolean, is_last boolean, is_open boolean"

    def lattices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, bs, many, pv, pe, gv, ge, atomic, last, opened = [], [], [], [], [0], [], [0], [], [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got, is_open = blocks(v)
                row_many = any(g for _, g in got)
                is_array = v.lstrip().startswith("[")
                for b, (parts, gaps) in enumerate(got):
                    ks.append(k)
                    bs.append(b)
                    many.append(row_many)
                    pv.extend(parts)
                    pe.append(len(pv))
                    gv.extend(gaps)
                    ge.append(len(gv))
                    atomic.append(is_array)
                    last.append(b == len(got) - 1)
                    opened.append(is_open and b == len(got) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.int64()), pa.array(bs, pa.int32()), pa.array(many, pa.bool_()), pa.ListArray.from_arrays(pa.array(pe, pa.int32()), strings(pv)),
                 pa.ListArray.from_arrays(pa.array(ge, pa.int32()), strings(gv)), pa.array(atomic, pa.bool_()), pa.array(last, pa.bool_()), pa.array(opened, pa.bool_())],
                names=["k", "blk", "many", "parts", "gaps", "atomic", "is_last", "is_open"])

    units = cut(df.filter(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), text).mapInArrow(lattices, schema))
    sure = units.filter(F.size("gaps") == 0).withColumn("label_value", F.element_at("parts", 1))
    open_units = units.filter(F.size("gaps") > 0)
    done = sure.filter(~F.col("many")).select(F.col("k").alias(key), F.col("blk").alias("pos"), "label_value", "is_last", "is_open")

    # what arrays tell of marks inside labels, against what is met outside: how often each kind separates
    single, label = F.size("gaps") == 0, F.element_at("parts", 1)
    each = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0))
    marks = F.length(F.regexp_replace(label, "[^,/]", ""))
    seen = units.agg(
        each(single & F.col("atomic"), 1).alias("arrays"), each(single, 1).alias("n"), each(~single, 1).alias("lattices"), F.collect_set(F.when(single & (marks > 0), marks)).alias("spans"),
        *(each(single & F.col("atomic"), F.size(F.split(label, m)) - 1).alias(f"in{i}") for i, m in enumerate(KINDS)),
        *(each(~single, F.size(F.filter("gaps", _is(m)))).alias(f"s{i}") for i, m in enumerate(KINDS)),
        *(each(~single & F.exists("gaps", _is(m)), F.size("parts")).alias(f"p{i}") for i, m in enumerate(KINDS))).first()
    if not seen["lattices"]:
        return done
    rates = {}
    for i, m in enumerate(KINDS):
        per_label = seen[f"in{i}"] / max(1, seen["arrays"])
        # a slash stands in labels of any row, a comma's rows have no other mark: their own parts count
        labels = seen["n"] + seen[f"p{i}"] if m == "/" else seen[f"p{i}"]
        met = seen[f"s{i}"]
        sure_of = min(met, seen["arrays"])
        guess = min(0.95, max(0.05, 1 - per_label * labels / max(1, met)))
        rates[m] = (PRIOR[m] * PRIOR_SITES + guess * sure_of) / (PRIOR_SITES + sure_of)
    spans = sorted(seen["spans"])

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"k": [], "blk": [], "i": [], "j": [], "label_value": [], "gap": []}
            for k, b, parts, gaps in zip(*(batch.column(c).to_pylist() for c in ("k", "blk", "parts", "gaps"))):
                n = len(parts)
                for i in range(n):
                    for c, v in zip(out, (k, b, i, i + 1, parts[i], gaps[i] if i < n - 1 else "")):
                        out[c].append(v)
                    for s in spans:  # no value known for certain has any other number of sites
                        if i + s + 1 > n:
                            break
                        for c, v in zip(out, (k, b, i, i + s + 1, _value(parts, gaps, i, i + s + 1), "")):
                            out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["k"], pa.int64()), *(pa.array(out[c], pa.int32()) for c in ("blk", "i", "j")), strings(out["label_value"]), strings(out["gap"])], names=list(out))

    values = sure.groupBy("label_value").agg(F.count("*").cast("double").alias("c0"))
    values = cut(values)
    once = values.agg(F.sum("c0").alias("total"), F.sum(F.when(F.col("c0") == 1, 1).otherwise(0)).alias("once")).first()
    total = float((once["total"] or 0) + seen["lattices"] or 1)
    new = min(0.9, max(0.05, (once["once"] or 0) / total))
    found = open_units.select("k", "blk", "parts", "gaps").mapInArrow(arcs, "k long, blk int, i int, j int, label_value string, gap string")
    # values known for certain are looked up once; from then on the lattices' own arcs are all that is read
    post = cut(found.join(values, "label_value", "left").filter("j - i = 1 OR c0 IS NOT NULL").select("k", "blk", "i", "j", "label_value", "gap", F.coalesce("c0", F.lit(0.0)).alias("c0"), F.lit(0.0).alias("post"), F.lit(None).cast("string").alias("mark"), F.lit(0.0).alias("cuts"), F.lit(0.0).alias("sites"), F.lit(0.0).alias("likely")))
    drop(values)
    likely = None
    for turn in range(ROUNDS + 1):
        own = post.filter("mark IS NULL")
        arc = lambda c: F.struct("i", "j", "label_value", "gap", "c0", c.alias("c"))
        if turn:
            # a span over sites counts where it was seen for certain: repeated rows would vouch for each other
            met = own.filter("post > 0").groupBy(F.col("label_value").alias("v")).agg(F.sum("post").alias("more"))
            own = own.join(met, F.col("label_value") == F.col("v"), "left")
            # an arc's own share of the count says nothing about it
            rows = own.groupBy("k", "blk").agg(F.collect_list(arc(F.col("c0") + F.coalesce("more", F.lit(0.0)) - F.col("post"))).alias("arcs"))
        else:
            rows = own.groupBy("k", "blk").agg(F.collect_list(arc(F.col("c0"))).alias("arcs"))
        if turn == ROUNDS or likely is not None and likely[1] - likely[0] < SETTLED:
            break
        post = cut(rows.mapInArrow(_estimate(dict(rates), total, new), post.schema), post)
        marks = post.filter("mark IS NOT NULL").groupBy("mark").agg(F.sum("cuts").alias("cuts"), F.sum("sites").alias("sites"), F.sum("likely").alias("likely")).collect()
        rates |= {r["mark"]: min(0.999, max(0.001, (r["cuts"] + PRIOR[r["mark"]] * PRIOR_SITES) / (r["sites"] + PRIOR_SITES))) for r in marks if r["mark"]}
        now = sum(r["likely"] for r in marks) / max(1, sum(r["sites"] for r in marks))
        likely = (likely[1] if likely else -math.inf, now)
    best = rows.mapInArrow(_best(dict(rates), total, new), "k long, blk int, i int, label_value string, ends boolean")
    # rows with a lattice: their certain values and the chosen arcs, in order
    flags = open_units.select("k", "blk", "is_last", "is_open")
    chosen = best.join(flags, ["k", "blk"]).select("k", "blk", "i", "label_value", (F.col("is_last") & F.col("ends")).alias("is_last"), (F.col("is_open") & F.col("ends")).alias("is_open"))
    rest = chosen.unionByName(sure.filter("many").select("k", "blk", F.lit(0).alias("i"), "label_value", "is_last", "is_open"))
    rest = rest.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("blk", "i")) - 1)
    return done.unionByName(rest.select(F.col("k").alias(key), "pos", "label_value", "is_last", "is_open"))


def _estimate(rates: dict, total: float, new: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("k", "blk", "i", "j", "label_value", "gap", "c0", "post", "mark", "cuts", "sites", "likely")}
            cuts, sites, likely = Counter(), Counter(), 0.0
            for k, b, arcs in zip(*(batch.column(c).to_pylist() for c in ("k", "blk", "arcs"))):
                lattice = Lattice(arcs, total, new, rates)
                w, own, at = lattice.posterior()
                likely += w
                known = [x for e in lattice.ends for *_, x in e]
                for x, p in [*zip(lattice.arcs, own), *((x, 0.0) for x in known)]:
                    for c, v in zip(out, (k, b, x["i"], x["j"], x["label_value"], x["gap"], x["c0"], p, None, 0.0, 0.0, 0.0)):
                        out[c].append(v)
                for m, p in zip(lattice.marks, at):
                    cuts[m] += p
                    sites[m] += 1
            for m, s in sites.items():
                for c, v in zip(out, (None, None, None, None, None, None, None, None, m, cuts[m], s, likely)):
                    out[c].append(v)
                likely = 0.0
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["k"], pa.int64()), *(pa.array(out[c], pa.int32()) for c in ("blk", "i", "j")), strings(out["label_value"]), strings(out["gap"]), *(pa.array(out[c], pa.float64()) for c in ("c0", "post")),
                 strings(out["mark"]), *(pa.array(out[c], pa.float64()) for c in ("cuts", "sites", "likely"))], names=list(out))

    return run


def _best(rates: dict, total: float, new: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("k", "blk", "i", "label_value", "ends")}
            for k, b, arcs in zip(*(batch.column(c).to_pylist() for c in ("k", "blk", "arcs"))):
                lattice = Lattice(arcs, total, new, rates)
                for i, j in lattice.best():
                    for c, v in zip(out, (k, b, i, lattice.value(i, j), j == lattice.n)):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["k"], pa.int64()), pa.array(out["blk"], pa.int32()), pa.array(out["i"], pa.int32()), strings(out["label_value"]), pa.array(out["ends"], pa.bool_())], names=list(out))

    return run
