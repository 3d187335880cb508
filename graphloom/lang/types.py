"""Types and their one-step inference.

A type is an atom's name or a pair (argument type, result type).
"""

from __future__ import annotations

NUM, BOOL, STR, DATE, ENT = "num", "t", "s", "d", "e"
ANY, FAIL = "⊤", "⊥"

Type = str | tuple


class TypeFailure(Exception):
    """A term has no type."""


def arrow(*parts: Type) -> Type:
    """arrow(a, b, c) is a=>(b=>c)."""
    out = parts[-1]
    for p in reversed(parts[:-1]):
        out = (p, out)
    return out


def show_type(t: Type) -> str:
    if isinstance(t, str):
        return t
    left = f"({show_type(t[0])})" if isinstance(t[0], tuple) else t[0]
    return f"{left}=>{show_type(t[1])}"


def _open(t: Type) -> bool:
    return t == ANY or (isinstance(t, tuple) and (_open(t[0]) or _open(t[1])))


def _fill(t: Type, atom: str) -> Type:
    return atom if t == ANY else (_fill(t[0], atom), _fill(t[1], atom)) if isinstance(t, tuple) else t


def apply_type(functor: Type | None, argument: Type | None) -> Type:
    """The type of an application, FAIL if there is none. Every ⊤ of the functor becomes the argument's
    type, which must then be an atom, so both sides of a comparison agree."""
    if not isinstance(functor, tuple) or argument is None or argument == FAIL:
        return FAIL
    if _open(functor):
        if not isinstance(argument, str) or argument == ANY:
            return FAIL
        functor = _fill(functor, argument) if functor[0] == ANY else functor
    return functor[1] if functor[0] == argument else FAIL
