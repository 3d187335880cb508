"""Immutable terms with de Bruijn indices, substitution, normalisation and evaluation."""

from __future__ import annotations

import datetime
import operator
from collections.abc import Callable
from dataclasses import dataclass, replace

from graphloom.lang.types import BOOL, DATE, ENT, FAIL, NUM, STR, Type, TypeFailure, apply_type, show_type


@dataclass(frozen=True)
class Var:
    name: str
    index: int | None = None


@dataclass(frozen=True)
class Lam:
    name: str
    type: Type
    body: Term


@dataclass(frozen=True)
class Exists:
    name: str
    type: Type
    body: Term
    marked: bool = False


@dataclass(frozen=True)
class App:
    fn: Term
    arg: Term


@dataclass(frozen=True)
class Const:
    value: object
    type: Type


@dataclass(frozen=True)
class Fn:
    """A function by name: kind is 'op', 'entity', 'property' or 'external'."""

    name: str
    type: Type
    kind: str = "op"
    call: Callable | None = None


Term = Var | Lam | Exists | App | Const | Fn


def constant(value) -> Const:
    kinds = {bool: BOOL, str: STR, datetime.date: DATE}
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return Const(float(value), NUM)
    return Const(value, kinds[type(value)])


def entity(name: str) -> Fn:
    return Fn(name, (ENT, BOOL), "entity")


def prop(name: str, value: Type = ENT) -> Fn:
    return Fn(name, (ENT, (value, BOOL)), "property")


def apply(fn: Term, *args: Term) -> Term:
    for a in args:
        fn = App(fn, a)
    return fn


def bind(name: str, body: Term, depth: int = 0) -> Term:
    """body with the free variable `name` bound by a binder just outside."""
    match body:
        case Var(name=n, index=None) if n == name:
            return Var(n, depth)
        case Lam() | Exists():
            return replace(body, body=bind(name, body.body, depth + 1))
        case App(fn=f, arg=a):
            return App(bind(name, f, depth), bind(name, a, depth))
    return body


def shift(term: Term, by: int, above: int = 0) -> Term:
    match term:
        case Var(index=i) if i is not None and i >= above:
            return replace(term, index=i + by)
        case Lam() | Exists():
            return replace(term, body=shift(term.body, by, above + 1))
        case App(fn=f, arg=a):
            return App(shift(f, by, above), shift(a, by, above))
    return term


def substitute(body: Term, value: Term, depth: int = 0) -> Term:
    """body without its outermost binder, whose variable stands for value."""
    match body:
        case Var(index=i) if i is not None:
            return shift(value, depth) if i == depth else replace(body, index=i - 1) if i > depth else body
        case Lam() | Exists():
            return replace(body, body=substitute(body.body, value, depth + 1))
        case App(fn=f, arg=a):
            return App(substitute(f, value, depth), substitute(a, value, depth))
    return body


def normalise(term: Term) -> Term:
    """The normal form, also under binders; an application that can't be reduced stays.

    Typed terms always have one.
    """
    match term:
        case App(fn=f, arg=a):
            f, a = normalise(f), normalise(a)
            return normalise(substitute(f.body, a)) if isinstance(f, Lam) else App(f, a)
        case Lam() | Exists():
            return replace(term, body=normalise(term.body))
    return term


def is_closed(term: Term, depth: int = 0) -> bool:
    match term:
        case Var(index=i):
            return i is not None and i < depth
        case Lam():
            return is_closed(term.body, depth + 1)
        case Exists():
            return is_closed(term.body, depth + 1)
        case App(fn=f, arg=a):
            return is_closed(f, depth) and is_closed(a, depth)
    return True


def spine(term: Term) -> tuple[Term, list[Term]]:
    """Head and arguments of nested applications."""
    args: list[Term] = []
    while isinstance(term, App):
        args.append(term.arg)
        term = term.fn
    return term, args[::-1]


def _divide(a: float, b: float) -> float:
    return a / b


OPS: dict[str, tuple[Callable, int]] = {
    "+": (operator.add, 2), "-": (operator.sub, 2), "*": (operator.mul, 2), "/": (_divide, 2),
    "and": (lambda a, b: a and b, 2), "or": (lambda a, b: a or b, 2), "not": (operator.not_, 1),
    "==": (operator.eq, 2), "!=": (operator.ne, 2), "<": (operator.lt, 2), "<=": (operator.le, 2), ">": (operator.gt, 2), ">=": (operator.ge, 2),
    "CarS": (lambda s: s[:1], 1), "CdrS": (lambda s: s[1:], 1), "ConsS": (operator.add, 2),
}


def evaluate(term: Term) -> Term:
    """The normal form with every operator or external function on constants replaced by its value.

    Dividing by zero raises; quantifiers over the graph stay, as they need one.
    """
    term = normalise(term)
    match term:
        case App():
            head, args = spine(term)
            args = [evaluate(a) for a in args]
            if isinstance(head, Fn) and all(isinstance(a, Const) for a in args):
                call, arity = OPS.get(head.name, (head.call, None)) if head.kind == "op" else (head.call, None)
                result = head.type
                for _ in args:
                    result = result[1] if isinstance(result, tuple) else None
                if call and (arity == len(args) or (arity is None and not isinstance(result, tuple))):
                    value = call(*(a.value for a in args))
                    return value if isinstance(value, Const) else constant(value)
            return apply(head if isinstance(head, Fn) else evaluate(head) if not isinstance(head, App) else head, *args)
        case Lam() | Exists():
            return replace(term, body=evaluate(term.body))
    return term


def show(term: Term) -> str:
    def go(x: Term, names: tuple[str, ...]) -> str:
        match x:
            case Var(index=None, name=n):
                return n
            case Var(index=i):
                return names[i] if i < len(names) else f"#{i}"
            case Const(value=v, type=t):
                return f'"{v}"' if t == STR else str(v)
            case Fn(kind="entity", name=n):
                return f"wd:{n}"
            case Fn(kind="property", name=n):
                return f"wdt:{n}"
            case Fn(name=n):
                return n
            case Lam() | Exists():
                name = x.name
                while name in names:
                    name += "'"
                word = "lambda" if isinstance(x, Lam) else "@exists" if x.marked else "exists"
                return f"({word} ({name}:{show_type(x.type)}) {go(x.body, (name, *names))})"
            case App():
                head, args = spine(x)
                return "(" + " ".join(go(y, names) for y in (head, *args)) + ")"
        return repr(x)

    return go(term, ())


def typecheck(term, strict: bool = True) -> Type:
    """The type of a term. Without a type: TypeFailure, or FAIL if not strict."""
    def go(x, env: tuple[Type, ...]) -> Type:
        match x:
            case Var(index=None, name=name):
                raise TypeFailure(f"free variable {name}")
            case Var(index=i):
                return env[i]
            case Const(type=t) | Fn(type=t):
                return t
            case Lam(type=t, body=body):
                return (t, go(body, (t, *env)))
            case Exists(type=t, body=body):
                return go(body, (t, *env))
            case App(fn=fn, arg=arg):
                a, b = go(fn, env), go(arg, env)
                out = apply_type(a, b)
                if out == FAIL:
                    raise TypeFailure(f"{show(fn)} : {show_type(a)} doesn't apply to {show(arg)} : {show_type(b)}")
                return out
        raise TypeFailure(f"no term: {x!r}")

    try:
        return go(term, ())
    except TypeFailure:
        if strict:
            raise
        return FAIL
