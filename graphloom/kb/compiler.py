"""Closed formulas to DataFrame plans.

A formula becomes a disjunction of conjunctions of atoms. Each conjunction is a chain of natural joins,
begun with what is most restricted and going on with what is connected, so that Catalyst sees one plain join
tree; disjuncts are united by name, their unbound variables null. Rows are never made distinct on the way: a
count sees every binding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.lang.terms import App, Const, Exists, Fn, Term, Var, normalise, spine, substitute, typecheck
from graphloom.lang.types import BOOL, DATE, ENT, NUM, STR, TypeFailure

#: Column of the triples that holds a value of each type.
OBJECT = {ENT: "o", NUM: "o_num", STR: "o_str", DATE: "o_date"}
#: Disjuncts that a formula may unfold to.
MOST_DISJUNCTS = 256

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_ARITH: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}


class Unsafe(ValueError):
    """A formula whose variables aren't restricted to anything in the graph."""


@dataclass(frozen=True)
class Atom:
    """kind 'entity' (name, x), 'property' (name, x, y), 'test' (term) or 'not' (disjuncts)."""

    kind: str
    name: str = ""
    args: tuple = ()
    vars: frozenset[str] = frozenset()


@dataclass
class Scope:
    """Variables by column name: type, and whether they are answers."""

    types: dict[str, str]
    marked: list[str]


def column_of(term: Term) -> Column:
    """A test's term on typed columns."""
    if isinstance(term, Var):
        return F.col(term.name)
    if isinstance(term, Const):
        return F.lit(term.value)
    head, args = spine(term)
    if isinstance(head, Fn):
        cols = [column_of(a) for a in args]
        if head.name in _COMPARE:
            return _COMPARE[head.name](*cols)
        if head.name in _ARITH:
            return _ARITH[head.name](*(c.cast("double") for c in cols))
        if head.name == "and":
            return cols[0] & cols[1]
        if head.name == "or":
            return cols[0] | cols[1]
        if head.name == "not":
            return ~cols[0]
        if head.name == "CarS":
            return F.substring(cols[0], 1, 1)
        if head.name == "CdrS":
            return F.substr(cols[0], F.lit(2))
        if head.name == "ConsS":
            return F.concat(*cols)
    raise Unsafe(f"{head!r} can't be a column")


def _vars(term: Term) -> frozenset[str]:
    if isinstance(term, Var):
        return frozenset([term.name])
    return _vars(term.fn) | _vars(term.arg) if isinstance(term, App) else frozenset()


class Compiler:
    def __init__(self, triples: DataFrame, products: bool = False) -> None:
        self.triples = triples
        self.products = products
        self.scope = Scope({}, [])

    def open(self, term: Term) -> Term:
        """term with its quantified variables replaced by named columns."""
        while isinstance(term, Exists):
            name = f"x{len(self.scope.types)}"
            self.scope.types[name] = term.type
            if term.marked:
                self.scope.marked.append(name)
            term = substitute(term.body, Var(name))
        return term

    def disjuncts(self, term: Term) -> list[list[Atom]]:
        term = self.open(term)
        head, args = spine(term)
        if isinstance(term, Const) and term.type == BOOL:
            return [[]] if term.value else []
        if isinstance(head, Fn) and head.name == "and" and len(args) == 2:
            left, right = self.disjuncts(args[0]), self.disjuncts(args[1])
            if len(left) * len(right) > MOST_DISJUNCTS:
                raise ValueError("the formula unfolds to too many disjuncts")
            return [a + b for a in left for b in right]
        if isinstance(head, Fn) and head.name == "or" and len(args) == 2:
            return self.disjuncts(args[0]) + self.disjuncts(args[1])
        if isinstance(head, Fn) and head.name == "not" and len(args) == 1:
            before = dict(self.scope.types)
            inner = self.disjuncts(args[0])
            used = frozenset().union(*(a.vars for d in inner for a in d)) & frozenset(before)
            return [[Atom("not", args=tuple(tuple(d) for d in inner), vars=used)]]
        if isinstance(head, Fn) and head.kind == "entity" and len(args) == 1:
            return [[Atom("entity", head.name, tuple(args), _vars(args[0]))]]
        if isinstance(head, Fn) and head.kind == "property" and len(args) == 2:
            return [[Atom("property", head.name, tuple(args), _vars(args[0]) | _vars(args[1]))]]
        if isinstance(head, Fn) and head.name in _COMPARE:
            return [[Atom("test", args=(term,), vars=_vars(term))]]
        raise Unsafe(f"no formula over the graph: {head!r}")

    def relation(self, atom: Atom) -> DataFrame:
        """The triples of a property as a relation over its variables."""
        x, y = atom.args
        value = y.type if isinstance(y, Const) else self.scope.types[y.name] if isinstance(y, Var) else ENT
        rows = self.triples.filter(F.col("p") == atom.name).select(F.col("s").alias("__s"), F.col(OBJECT[value]).alias("__o")).filter("__o IS NOT NULL")
        out = []
        for col, arg in (("__s", x), ("__o", y)):
            if isinstance(arg, Const):
                rows = rows.filter(F.col(col) == F.lit(arg.value))
            elif isinstance(arg, Fn) and arg.kind == "entity":
                rows = rows.filter(F.col(col) == arg.name)
            elif isinstance(arg, Var):
                out.append((col, arg.name))
            else:
                raise Unsafe("a property takes variables and constants")
        if len(out) == 2 and out[0][1] == out[1][1]:
            rows, out = rows.filter("__s = __o"), out[:1]
        return rows.select(*(F.col(c).alias(n) for c, n in out)) if out else rows.select(F.lit(1).alias("__one"))

    def conjunction(self, atoms: list[Atom]) -> DataFrame | None:
        """The bindings of a conjunction; None if it can have none."""
        fixed: dict[str, str] = {}
        for a in atoms:
            if a.kind == "entity":
                (arg,) = a.args
                name = arg.name
                if isinstance(arg, Fn):
                    if arg.name != a.name:
                        return None
                elif fixed.setdefault(name, a.name) != a.name:
                    return None
        left = [a for a in atoms if a.kind == "property"]
        pinned = lambda a: -sum(not isinstance(x, Var) or x.name in fixed for x in a.args)
        out: DataFrame | None = None
        have: set[str] = set()
        while left:
            near = [a for a in left if a.vars & have] or left
            atom = min(near, key=pinned)
            left.remove(atom)
            rel = self.relation(atom)
            for v in atom.vars:
                if v in fixed:
                    rel = rel.filter(F.col(v) == fixed[v])
            shared = sorted(atom.vars & have)
            if out is None:
                out = rel
            elif shared:
                out = out.join(rel, shared)
            elif self.products:  # two parts of the formula that share nothing: all their combinations are its answers
                out = out.crossJoin(rel)
            else:
                raise Unsafe("parts of the formula share no variable: all their combinations would be its answers; products=True allows that")
            have |= atom.vars
        for v, name in fixed.items():
            if v not in have:
                out = self.triples.sparkSession.range(1).select(F.lit(name).alias(v)) if out is None else out.withColumn(v, F.lit(name))
                have.add(v)
        if out is None:
            out = self.triples.sparkSession.range(1).select(F.lit(1).alias("__one"))
        for a in atoms:
            if a.kind in ("test", "not") and not a.vars <= have:
                raise Unsafe(f"not restricted: {', '.join(sorted(a.vars - have))}")
        for a in atoms:
            if a.kind == "test":
                out = out.filter(column_of(a.args[0]))
        for a in atoms:
            if a.kind == "not":
                inner = self.union([list(d) for d in a.args], keep=a.vars)
                if inner is not None:
                    on = sorted(a.vars)
                    out = out.join(inner, on, "left_anti") if on else out.filter(F.lit(inner.isEmpty()))
        return out.drop("__one") if have else out

    def union(self, disjuncts: list[list[Atom]], keep: frozenset[str] | None = None) -> DataFrame | None:
        parts = [p for d in disjuncts if (p := self.conjunction(d)) is not None]
        if keep is not None:
            for p in parts:
                if not keep <= {*p.columns}:
                    raise Unsafe("every branch of a negation must restrict the same variables")
            parts = [p.select(*sorted(keep)) if keep else p.select(F.lit(1).alias("__one")) for p in parts]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


class PlanCompiler(Compiler):
    """A formula whose ids stand for the columns of a table of plans: all plans of one shape are answered by one chain of joins.

    plans has the columns `keys` and one column for each id of the formula, named by `columns` (id to column).
    """

    def __init__(self, triples: DataFrame, plans: DataFrame, keys: list[str], columns: dict[str, str]) -> None:
        super().__init__(triples)
        self.plans, self.keys, self.columns = plans, keys, columns

    def relation(self, atom: Atom) -> DataFrame:
        x, y = atom.args
        value = y.type if isinstance(y, Const) else self.scope.types[y.name] if isinstance(y, Var) else ENT
        rows = self.triples.select("p", F.col("s").alias("__s"), F.col(OBJECT[value]).alias("__o")).filter("__o IS NOT NULL")
        out = {self.columns[atom.name]: "p"}
        for col, arg in (("__s", x), ("__o", y)):
            if isinstance(arg, Const):
                rows = rows.filter(F.col(col) == F.lit(arg.value))
                continue
            if not isinstance(arg, Var) and not (isinstance(arg, Fn) and arg.kind == "entity"):
                raise Unsafe("a property takes variables and constants")
            name = arg.name if isinstance(arg, Var) else self.columns[arg.name]
            if name in out:  # twice in one atom
                rows = rows.filter(F.col(col) == F.col(out[name]))
            else:
                out[name] = col
        return rows.select(*(F.col(c).alias(n) for n, c in out.items()))

    def conjunction(self, atoms: list[Atom]) -> DataFrame | None:
        out, have = self.plans, set()
        for a in atoms:
            if a.kind == "entity":
                (arg,) = a.args
                given = F.col(self.columns[a.name])
                if isinstance(arg, Fn):
                    out = out.filter(F.col(self.columns[arg.name]) == given)
                elif arg.name in have:
                    out = out.filter(F.col(arg.name) == given)
                else:
                    out = out.withColumn(arg.name, given)
                    have.add(arg.name)
        left = [a for a in atoms if a.kind == "property"]
        while left:
            atom = max(left, key=lambda a: (len(a.vars & have), sum(not isinstance(x, Var) for x in a.args)))
            left.remove(atom)
            rel = self.relation(atom)
            out = out.join(rel, [c for c in rel.columns if c in out.columns])
            have |= atom.vars
        for a in atoms:
            if a.kind in ("test", "not") and not a.vars <= have:
                raise Unsafe(f"not restricted: {', '.join(sorted(a.vars - have))}")
        for a in atoms:
            if a.kind == "test":
                out = out.filter(column_of(a.args[0]))
        for a in atoms:
            if a.kind == "not":
                inner = self.union([list(d) for d in a.args], keep=a.vars | frozenset(self.keys))
                if inner is not None:
                    out = out.join(inner.distinct(), [*self.keys, *sorted(a.vars)], "left_anti")
        return out


def answer_plans(term: Term, triples: DataFrame, plans: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame | None:
    """(keys, answer): the distinct answers of all plans, for a closed formula with one answer; None where it has another number."""
    term = normalise(term)
    if typecheck(term) != BOOL:
        raise TypeFailure("a query must be of type t")
    c = PlanCompiler(triples, plans, keys, columns)
    outer = c.open(term)
    names = c.scope.marked or list(c.scope.types)
    if len(names) != 1:
        return None
    rows = c.union(c.disjuncts(outer))
    if rows is None or names[0] not in rows.columns:
        return None
    return rows.select(*keys, F.col(names[0]).cast("string").alias("answer")).filter("answer IS NOT NULL").distinct()


def compile_formula(term: Term, triples: DataFrame, products: bool = False) -> tuple[DataFrame | None, list[str], Scope]:
    """(bindings, answer columns, scope) of a closed formula. Without a marked variable all outer ones are answers. A formula
    whose parts share no variable is Unsafe unless `products` allows all their combinations."""
    term = normalise(term)
    if typecheck(term) != BOOL:
        raise TypeFailure("a query must be of type t")
    c = Compiler(triples, products)
    outer = c.open(term)
    names = list(c.scope.types)
    rows = c.union(c.disjuncts(outer))
    return rows, c.scope.marked or names, c.scope
