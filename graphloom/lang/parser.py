"""The written form of terms."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterable

from graphloom.lang.terms import Exists, Fn, Lam, Term, Var, apply, bind, constant, entity, prop
from graphloom.lang.types import ANY, BOOL, ENT, NUM, STR, Type, arrow

_TOKEN = re.compile(
    r"""\s*(?:(?P<string>"[^"]*")|(?P<id>wdt?:[A-Z]\d+)|(?P<date>\d{4}-\d{2}-\d{2})|(?P<number>\d+(?:\.\d+)?)"""
    r"""|(?P<sign>=>|[():])|(?P<name>@?[^\W\d][\w'’]*|==|!=|<=|>=|[-+*/<>]))"""
)
RESERVED = {"define", "lambda", "exists", "@exists", "True", "False"}


class TermSyntaxError(SyntaxError):
    """A text that is no program of terms."""


BUILTINS: dict[str, Type] = {
    **dict.fromkeys("+-*/", arrow(NUM, NUM, NUM)),
    "and": arrow(BOOL, BOOL, BOOL), "or": arrow(BOOL, BOOL, BOOL), "not": arrow(BOOL, BOOL),
    **dict.fromkeys(("==", "!=", "<", "<=", ">", ">="), arrow(ANY, ANY, BOOL)),
    "CarS": arrow(STR, STR), "CdrS": arrow(STR, STR), "ConsS": arrow(STR, STR, STR),
}

# The combinators that parsing actions and queries share, in the language itself.
COMBINATORS = """
(define SWAP (lambda (P:e=>e=>t x:e y:e) (P y x)))
(define JOIN (lambda (P:e=>e=>t Q:e=>t x:e) (exists (y:e) (and (P x y) (Q y)))))
(define AND (lambda (P:e=>t Q:e=>t x:e) (and (P x) (Q x))))
(define OR (lambda (P:e=>t Q:e=>t x:e) (or (P x) (Q x))))
"""


class Context:
    """Names: operators, macros defined by the user, external functions, and the types of properties' values."""

    def __init__(self, property_types: dict[str, Type] | None = None) -> None:
        self.terms: dict[str, Term] = {n: Fn(n, t) for n, t in BUILTINS.items()}
        self.property_types = property_types or {}

    def define(self, name: str, term: Term) -> None:
        """The last definition of a name holds."""
        self.terms[name] = term

    def function(self, name: str, type: Type, call: Callable) -> None:
        """An external function, evaluated once all its arguments are constants."""
        self.terms[name] = Fn(name, type, "external", call)

    def source(self, lines: Iterable[str]) -> None:
        """Definitions, one a line; # starts a comment."""
        for line in lines:
            line = line.split("#", 1)[0].strip()
            if line:
                parse(line, self)

    def copy(self) -> Context:
        out = Context(self.property_types)
        out.terms = dict(self.terms)
        return out


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise TermSyntaxError(f"no token at {text[at:at + 20]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str, context: Context, mark: str) -> None:
        self.toks = tokens(text)
        self.at = 0
        self.context = context
        self.mark = mark

    def next(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.toks):
            raise TermSyntaxError("the text ends too early")
        kind, text = self.toks[self.at]
        if want is not None and text != want:
            raise TermSyntaxError(f"{want!r} expected, {text!r} found")
        self.at += 1
        return kind, text

    def peek(self, ahead: int = 0) -> str | None:
        return self.toks[self.at + ahead][1] if self.at + ahead < len(self.toks) else None

    def program(self) -> Term | None:
        last = None
        while self.at < len(self.toks):
            if self.peek() == "(" and self.peek(1) == "define":
                self.next(), self.next()
                _, name = self.next()
                self.context.define(name, self.term())
                self.next(")")
            else:
                last = self.term()
        return last

    def term(self, bound: tuple[str, ...] = ()) -> Term:
        kind, text = self.next()
        if kind == "string":
            return constant(text[1:-1])
        if kind == "number":
            return constant(float(text))
        if kind == "date":
            return constant(datetime.date.fromisoformat(text))
        if kind == "id":
            space, name = text.split(":")
            return entity(name) if space == "wd" else prop(name, self.context.property_types.get(name, ENT))
        if kind == "name":
            if text in ("True", "False"):
                return constant(text == "True")
            if text in RESERVED:
                raise TermSyntaxError(f"{text!r} out of place")
            # a bound name is a variable, a defined one stands for its term
            return Var(text) if text in bound else self.context.terms.get(text, Var(text))
        if text != "(":
            raise TermSyntaxError(f"{text!r} out of place")
        if self.peek() in ("lambda", "exists", "@exists"):
            _, word = self.next()
            self.next("(")
            params = []
            while self.peek() != ")":
                _, name = self.next()
                self.next(":")
                params.append((name, self.type()))
            self.next(")")
            if not params:
                raise TermSyntaxError(f"{word} without a variable")
            body = self.term((*bound, *(n for n, _ in params)))
            self.next(")")
            for i, (name, t) in reversed(list(enumerate(params))):
                marked = word == "@exists" and (self.mark == "all" or i == len(params) - 1)
                inner = bind(name, body)
                body = Lam(name, t, inner) if word == "lambda" else Exists(name, t, inner, marked)
            return body
        parts = []
        while self.peek() != ")":
            parts.append(self.term(bound))
        self.next(")")
        if not parts:
            raise TermSyntaxError("an empty application")
        return apply(*parts)

    def type(self) -> Type:
        kind, text = self.next()
        if text == "(":
            left: Type = self.type()
            self.next(")")
        elif kind == "name":
            left = text
        else:
            raise TermSyntaxError(f"a type expected, {text!r} found")
        if self.peek() == "=>":
            self.next()
            return (left, self.type())
        return left


def parse(text: str, context: Context | None = None, mark: str = "all") -> Term | None:
    """The last term of a program; definitions go to the context. None for a program of definitions only.

    mark='last' marks only the last variable of an @exists as an answer.
    """
    return _Reader(text, context if context is not None else standard_context(), mark).program()


def standard_context(property_types: dict[str, Type] | None = None) -> Context:
    out = Context(property_types)
    out.source(COMBINATORS.strip().splitlines())
    return out
