"""The term language: a small typed lambda calculus with quantifiers over a graph. Runs on the driver, touches no data."""

from graphloom.lang.parser import Context, parse
from graphloom.lang.terms import evaluate, is_closed, normalise, show, typecheck
from graphloom.lang.types import TypeFailure

__all__ = ["Context", "TypeFailure", "evaluate", "is_closed", "normalise", "parse", "show", "typecheck"]
