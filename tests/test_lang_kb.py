import datetime as dt
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.kb import KnowledgeBase
from graphloom.kb.compiler import Unsafe
from graphloom.lang import TypeFailure, evaluate, is_closed, normalise, parse, show, typecheck
from graphloom.lang.parser import Context, TermSyntaxError, standard_context
from graphloom.lang.terms import App, Exists, Lam, Var, constant, shift, substitute
from graphloom.lang.types import FAIL


def test_types():
    assert typecheck(parse("(lambda (x:num y:num) (+ (+ x 3) (+ y 3)))")) == ("num", ("num", "num"))
    assert typecheck(parse("(lambda (P:e=>t Q:e=>t) (exists (x:e) (and (P x) (Q x))))")) == (("e", "t"), (("e", "t"), "t"))
    assert typecheck(parse("(== 1 2)")) == "t"
    assert typecheck(parse('(== 1 "a")'), strict=False) == FAIL
    with pytest.raises(TypeFailure):
        typecheck(parse('(+ 1 "a")'))


def test_syntax_and_definitions():
    c = standard_context()
    c.source(["# a comment", "", "(define TWICE (lambda (x:num) (+ x x)))  # inline"])
    assert evaluate(parse("(TWICE (TWICE 2))", c)).value == 8.0
    assert evaluate(parse("(CdrS \"abc\")")).value == "bc" and evaluate(parse("(< 2024-01-01 2024-01-02)")).value is True
    for bad in ("(", ")", "()", "(lambda () 1)", "(lambda (x) 1)", "$"):
        with pytest.raises(TermSyntaxError):
            parse(bad)
    assert show(parse("(@exists (x:e y:e) (wdt:P1 x y))", mark="last")) == "(exists (x:e) (@exists (y:e) (wdt:P1 x y)))"


def test_external_functions_and_division():
    c = Context()
    c.function("hyp", ("num", ("num", "num")), lambda a, b: (a * a + b * b) ** 0.5)
    assert evaluate(parse("(hyp 3 4)", c)).value == 5.0
    assert show(evaluate(parse("(lambda (x:num) (hyp x 4))", c))) == "(lambda (x:num) (hyp x 4.0))"
    with pytest.raises(ZeroDivisionError):
        evaluate(parse("(/ 1 0)"))


def terms(depth, env):
    leaves = [st.just(constant(1.0))] + [st.just(Var(f"v{i}", i)) for i in range(env)]
    if depth == 0:
        return st.one_of(leaves)
    return st.one_of(*leaves, terms(depth - 1, env + 1).map(lambda b: Lam("v", "num", b)), terms(depth - 1, env + 1).map(lambda b: Exists("v", "num", b)), st.tuples(terms(depth - 1, env), terms(depth - 1, env)).map(lambda p: App(*p)))


@settings(max_examples=60, deadline=None)
@given(terms(3, 1), terms(2, 0))
def test_substitution_agrees_with_closures(body, value):
    def meaning(t, env):
        """The term as nested tuples in which variables are replaced by what env has for them."""
        match t:
            case Var(index=i):
                return env[i]
            case Lam() | Exists():
                return (type(t).__name__, lambda x: meaning(t.body, [x, *env]))
            case App():
                return ("app", meaning(t.fn, env), meaning(t.arg, env))
        return t

    def same(a, b, depth=0):
        if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0]:
            return same(a[1](depth), b[1](depth), depth + 1) if a[0] != "app" else same(a[1], b[1], depth) and same(a[2], b[2], depth)
        return a == b

    got = substitute(body, value)
    assert is_closed(got) and shift(got, 3) == got
    assert same(meaning(got, []), meaning(body, [meaning(value, [])]))


def test_normal_form_keeps_type():
    for text in ("((lambda (P:e=>t) (exists (x:e) (P x))) wd:Q42)", "((lambda (x:num) (lambda (y:num) (+ x y))) 2)", "(JOIN wdt:P1 (JOIN wdt:P2 wd:Q3))", "(SWAP wdt:P1)", "(OR wd:Q1 wd:Q2)"):
        t = parse(text)
        assert typecheck(normalise(t)) == typecheck(t)
        assert normalise(normalise(t)) == normalise(t)


IDS = ["Q1", "Q2", "Q3"]


def formula(rnd, depth, free):
    if depth == 0 or rnd.random() < 0.3:
        x, y = rnd.choice(free), rnd.choice(free)
        return rnd.choice([f"(wdt:P1 {x} {y})", f"(wdt:P2 {x} {y})", f"(wd:{rnd.choice(IDS)} {x})"])
    kind = rnd.random()
    if kind < 0.4:
        return f"(and {formula(rnd, depth - 1, free)} {formula(rnd, depth - 1, free)})"
    if kind < 0.7:
        return f"(or {formula(rnd, depth - 1, free)} {formula(rnd, depth - 1, free)})"
    v = f"z{len(free)}"
    return f"(exists ({v}:e) (and (wdt:P1 {rnd.choice(free)} {v}) {formula(rnd, depth - 1, [*free, v])}))"


def brute(term, triples, env):
    """Bindings with repetition of the quantified variables of a formula, as sets of assignments by brute force."""
    from graphloom.lang.terms import Fn, spine

    match term:
        case Exists():
            return sum(brute(term.body, triples, (x, *env)) for x in IDS)
        case App():
            head, args = spine(term)
            if isinstance(head, Fn) and head.name == "and":
                return brute(args[0], triples, env) * brute(args[1], triples, env)
            if isinstance(head, Fn) and head.name == "or":
                return brute(args[0], triples, env) + brute(args[1], triples, env)
            vals = [env[a.index] for a in args]
            if head.kind == "entity":
                return int(vals[0] == head.name)
            return int((vals[0], head.name, vals[1]) in triples)
    raise AssertionError(term)


def test_random_formulas_against_brute_force(spark):
    rnd = random.Random(11)
    triples = {(a, p, b) for a, p, b in itertools.product(IDS, ("P1", "P2"), IDS) if rnd.random() < 0.4}
    df = spark.createDataFrame([(a, p, b, None, None, None) for a, p, b in triples], "s string, p string, o string, o_num double, o_str string, o_date date").cache()
    kb = KnowledgeBase(df)
    done = 0
    while done < 12:
        inner = formula(rnd, 2, ["x"])
        text = f"(@exists (x:e) (and (wdt:P1 x x0) {inner}))".replace("(wdt:P1 x x0)", "(exists (w:e) (wdt:P2 x w))")
        t = normalise(parse(text))
        want = {x: n for x in IDS if (n := brute(t.body, triples, (x,)))}
        try:
            got = {r[0] for r in kb.query(text, None).collect()}
        except (Unsafe, ValueError):
            continue
        done += 1
        assert got == set(want), text
        assert kb.ask(text).first()["answer"] == bool(want)


def test_typed_values_negation_and_empty(spark):
    rows = [("Q1", "P8", None, 5.0, None, None), ("Q2", "P8", None, 7.5, None, None), ("Q1", "P10", None, None, None, dt.date(2024, 1, 1)), ("Q1", "P1", "Q3", None, None, None), ("Q2", "P1", "Q3", None, None, None), ("Q2", "P2", "Q1", None, None, None)]
    kb = KnowledgeBase(spark.createDataFrame(rows, "s string, p string, o string, o_num double, o_str string, o_date date"), standard_context({"P8": "num", "P10": "d"}))
    ask = lambda text: sorted(r[0] for r in kb.query(text).collect())
    assert ask("(@exists (x:e) (exists (v:num) (and (wdt:P8 x v) (> (+ v 1) 6))))") == ["Q2"]
    assert ask("(@exists (x:e) (exists (c:e) (and (wdt:P1 x c) (not (exists (y:e) (wdt:P2 x y))))))") == ["Q1"]
    assert ask("(@exists (x:e) (exists (v:d) (and (wdt:P10 x v) (<= v 2024-01-01))))") == ["Q1"]
    assert ask("(@exists (x:e) (and (wd:Q1 x) (wd:Q2 x)))") == []
    assert kb.count("(exists (x:e) (@exists (c:e) (wdt:P1 x c)))").first()["n"] == 2
    assert kb.count_distinct("(exists (x:e) (@exists (c:e) (wdt:P1 x c)))").first()["n"] == 1
    assert [r[0] for r in kb.top("(@exists (x:e v:num) (wdt:P8 x v))").collect()] == ["Q2"]
    with pytest.raises(Unsafe):
        kb.query("(@exists (x:e) (not (wdt:P1 x x)))").collect()
    with pytest.raises(TypeFailure):
        kb.query("(lambda (x:e) (wd:Q1 x))")
