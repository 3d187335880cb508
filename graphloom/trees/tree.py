"""Trees as values: reading, writing and the transformations of treebank preparation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Tree:
    label: str
    kids: tuple[Tree, ...] = ()

    @property
    def is_leaf(self) -> bool:
        return not self.kids

    @property
    def is_tag(self) -> bool:
        return len(self.kids) == 1 and self.kids[0].is_leaf

    def __str__(self) -> str:
        return self.label if self.is_leaf else f"({self.label} {' '.join(map(str, self.kids))})"

    def leaves(self) -> list[str]:
        return [self.label] if self.is_leaf else [x for k in self.kids for x in k.leaves()]

    def tags(self) -> list[Tree]:
        return [self] if self.is_tag else [x for k in self.kids for x in k.tags()]

    def nonterminals(self) -> list[str]:
        return [] if self.is_leaf else [self.label, *(x for k in self.kids for x in k.nonterminals())]


class TreeError(ValueError):
    """A text that is no bracketed tree."""


def read(text: str) -> Tree:
    """The tree of '(S (NP a) b)'. Anything else raises TreeError."""
    tokens = re.findall(r"[()]|[^\s()]+", text)
    at = 0

    def one() -> Tree:
        nonlocal at
        if at >= len(tokens):
            raise TreeError("the tree ends too early")
        tok = tokens[at]
        at += 1
        if tok == ")":
            raise TreeError("a bracket closes nothing")
        if tok != "(":
            return Tree(tok)
        label = ""
        if at < len(tokens) and tokens[at] not in "()":
            label = tokens[at]
            at += 1
        kids = []
        while at < len(tokens) and tokens[at] != ")":
            kids.append(one())
        if at >= len(tokens):
            raise TreeError("a bracket isn't closed")
        at += 1
        return Tree(label, tuple(kids))

    out = one()
    if at != len(tokens):
        raise TreeError("text after the tree")
    return out


def bottom_up(t: Tree, f: Callable[[Tree], Tree]) -> Tree:
    return f(replace(t, kids=tuple(bottom_up(k, f) for k in t.kids)))


def spans(t: Tree) -> list[tuple[int, int, str]]:
    """(from, to, label) of every node, leaves too."""
    out: list[tuple[int, int, str]] = []

    def go(x: Tree, i: int) -> int:
        j = i + 1 if x.is_leaf else i
        for k in x.kids:
            j = go(k, j)
        out.append((i, j, x.label))
        return j

    go(t, 0)
    return out


def compare(gold: Tree, got: Tree) -> tuple[float, float, float]:
    """Precision, recall and F of the sets of spans; F is 0 when both are."""
    a, b = set(spans(gold)), set(spans(got))
    p, r = len(a & b) / len(b), len(a & b) / len(a)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def strip_tags(t: Tree) -> Tree:
    return replace(t, kids=tuple(k.kids[0] if k.is_tag else strip_tags(k) for k in t.kids))


def add_tags(t: Tree, tags: Iterable[str]) -> Tree:
    """A tag from the sequence above every leaf."""
    rest = iter(tags)

    def go(x: Tree) -> Tree:
        return Tree(next(rest), (x,)) if x.is_leaf else replace(x, kids=tuple(go(k) for k in x.kids))

    return go(t)


def add_root(t: Tree, label: str = "TOP") -> Tree:
    return Tree(label, (t,))


def close_unaries(t: Tree, mark: str = "@") -> Tree:
    """Chains of single children as one node with a joined label; tags stay nodes of their own chain's end."""
    chain = [t.label]
    while len(t.kids) == 1 and not t.kids[0].is_leaf:
        t = t.kids[0]
        chain.append(t.label)
    return Tree(mark.join(chain), tuple(close_unaries(k, mark) for k in t.kids))


def expand_unaries(t: Tree, mark: str = "@") -> Tree:
    kids = tuple(expand_unaries(k, mark) for k in t.kids)
    if t.is_leaf or mark not in t.label:
        return Tree(t.label, kids)
    *above, last = t.label.split(mark)
    out = Tree(last, kids)
    for label in reversed(above):
        out = Tree(label, (out,))
    return out


def markovize(t: Tree, left: bool = True, mark: str = ":") -> Tree:
    """Binary branching of order 0; the new nodes' labels end in the mark."""
    kids = t.kids
    if len(kids) > 2:
        label = t.label if t.label.endswith(mark) else t.label + mark
        kids = (Tree(label, kids[:-1]), kids[-1]) if left else (kids[0], Tree(label, kids[1:]))
    return Tree(t.label, tuple(markovize(k, left, mark) for k in kids))


def unbinarize(t: Tree, mark: str = ":") -> Tree:
    def splice(x: Tree) -> Tree:
        return replace(x, kids=tuple(g for k in x.kids for g in (k.kids if not k.is_leaf and k.label.endswith(mark) else (k,))))

    return bottom_up(t, splice)


def strip_traces(t: Tree) -> Tree | None:
    """Without -NONE- nodes and what they leave empty; None if nothing is left."""
    if t.label == "-NONE-":
        return None
    if t.is_leaf:
        return t
    kids = tuple(k for x in t.kids if (k := strip_traces(x)) is not None)
    return replace(t, kids=kids) if kids else None


def strip_decoration(t: Tree) -> Tree:
    if t.is_tag or t.is_leaf:
        return t
    return Tree(t.label.split("-")[0].split("=")[0], tuple(strip_decoration(k) for k in t.kids))


def map_leaves(t: Tree, f: Callable[[str], str]) -> Tree:
    return bottom_up(t, lambda x: Tree(f(x.label)) if x.is_leaf else x)


def normalize_numbers(t: Tree, token: str = "<num>") -> Tree:
    return map_leaves(t, lambda w: token if re.match(r"[0-9]", w) else w)


def normalize_oov(t: Tree, lexicon: set[str], unknown: str) -> Tree:
    return map_leaves(t, lambda w: w if w in lexicon else unknown)


def prepare(t: Tree, tags: bool = True, unaries: bool = True) -> Tree | None:
    """A treebank tree as used for training: dummy root, numbers, traces and decoration; without tags or with closed unaries if asked."""
    out = strip_traces(normalize_numbers(add_root(t)))
    if out is None:
        return None
    out = strip_decoration(out)
    out = out if tags else strip_tags(out)
    return out if unaries else close_unaries(out)


def flatten(lines: Iterable[str]) -> list[str]:
    """The trees of a file whose trees run over lines, each on one line."""
    out, held, depth = [], [], 0
    for line in lines:
        depth += line.count("(") - line.count(")")
        held.append(line)
        if depth == 0 and "".join(held).strip():
            out.append(" ".join(" ".join(held).split()))
            held = []
    if "".join(held).strip():
        raise TreeError("the file ends inside a tree")
    return out
