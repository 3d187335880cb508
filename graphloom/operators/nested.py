"""Deeply nested records as related flat tables, linked by Dewey labels.

Every node of a record that a schema path names gets an ordinal path label ("3.0.2": third named
field, its first entry, that entry's third element). A node's parent is its label cut short, so the
tables need no generated keys; nodes of one schema path make one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of output gathered before a batch is handed over.
BATCH = 65536


def parse_path(path: str) -> list[str]:
    """'claims.*[].qualifiers.*[]' -> ['claims', '*', '[]', 'qualifiers', '*', '[]']."""
    out: list[str] = []
    for part in path.split("."):
        name = part.rstrip("[]")
        if name:
            out.append(name)
        out += ["[]"] * ((len(part) - len(name)) // 2)
    return out


def read_object(line: str | None) -> dict | None:
    """The JSON object that a dump line holds: blanks around it and one final comma are not part of it."""
    if not line:
        return None
    line = line.strip()
    if line.endswith(","):
        line = line[:-1]
    if not line.lstrip().startswith("{"):
        return None
    try:
        value = loads(line)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


_BLANKS = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity")
_NAMED = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def loads(text: str):
    """json.loads at any depth: what is nested too deeply for recursion is read with a stack of our own."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep_loads(text)


def _deep_loads(text: str):
    stack: list = []  # open arrays and objects
    names: list[str | None] = []  # of each object the field that waits for its value
    at, n = _BLANKS.match(text, 0).end(), len(text)
    while True:
        # a value, or the end of an empty array
        c = text[at : at + 1]
        if c in "[{" and c:
            stack.append([] if c == "[" else {})
            names.append(None)
            at = _BLANKS.match(text, at + 1).end()
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                if c == "{":
                    at = _name(text, at, names)
                continue
            at += 1
            value = stack.pop()
            names.pop()
        elif c == '"':
            value, at = scanstring(text, at + 1)
        else:
            m = _ATOM.match(text, at)
            if not m:
                raise ValueError(f"no value at {at}")
            at = m.end()
            value = _NAMED[m.group()] if m.group() in _NAMED else float(m.group()) if m.group(2) or m.group(3) else int(m.group())
        # what it belongs to, and all that ends with it
        while True:
            at = _BLANKS.match(text, at).end()
            if not stack:
                if at != n:
                    raise ValueError(f"more at {at}")
                return value
            if isinstance(stack[-1], list):
                stack[-1].append(value)
            else:
                stack[-1][names[-1]] = value
            c = text[at : at + 1]
            at += 1
            if c == ",":
                at = _BLANKS.match(text, at).end()
                if isinstance(stack[-1], dict):
                    at = _name(text, at, names)
                break
            if c != ("]" if isinstance(stack[-1], list) else "}"):
                raise ValueError(f"neither comma nor end at {at - 1}")
            value = stack.pop()
            names.pop()


def _name(text: str, at: int, names: list[str | None]) -> int:
    """Where the value of the field named at `at` begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    names[-1], at = scanstring(text, at + 1)
    at = _BLANKS.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return _BLANKS.match(text, at + 1).end()


def dumps(value) -> str:
    """json.dumps at any depth, other than ASCII as it is."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list = [value]
    held = object()  # before a piece of text that is written as it stands
    while todo:
        x = todo.pop()
        if x is held:
            out.append(todo.pop())
        elif isinstance(x, dict):
            parts: list = [held, "{"]
            for i, (k, v) in enumerate(x.items()):
                parts += [held, (", " if i else "") + json.dumps(k, ensure_ascii=False) + ": ", v]
            todo += _backwards([*parts, held, "}"], held)
        elif isinstance(x, list):
            parts = [held, "["]
            for i, v in enumerate(x):
                parts += [held, ", ", v] if i else [v]
            todo += _backwards([*parts, held, "]"], held)
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def _backwards(parts: list, held: object) -> list:
    """parts in the order in which a stack gives them back, a mark before its text."""
    out, i = [], 0
    while i < len(parts):
        step = 2 if parts[i] is held else 1
        out.append(parts[i : i + step][::-1])
        i += step
    return [x for group in out[::-1] for x in group]


def _trie(paths: Sequence[str]) -> tuple:
    """(index of the path that ends here or -1, [(step, ordinal, child)])."""
    root: list = [-1, {}]
    for i, path in enumerate(paths):
        at = root
        for step in parse_path(path):
            at = at[1].setdefault(step, [-1, {}])
        at[0] = i

    def freeze(node: list) -> tuple:
        return node[0], [(step, k, freeze(child)) for k, (step, child) in enumerate(node[1].items())]

    return freeze(root)


def _walk(value, node: tuple, label: str, keys: tuple, places: tuple, emit) -> None:
    end, steps = node
    if end >= 0:
        emit(end, label, keys, places, value)
    for step, k, child in steps:
        if step == "*":
            if isinstance(value, dict):
                for n, (key, sub) in enumerate(value.items()):
                    if sub is not None:
                        _walk(sub, child, f"{label}.{n}", (*keys, key), places, emit)
        elif step == "[]":
            if value is not None:
                for n, sub in enumerate(value if isinstance(value, list) else (value,)):
                    _walk(sub, child, f"{label}.{n}", keys, (*places, n), emit)
        elif isinstance(value, dict) and value.get(step) is not None:
            _walk(value[step], child, f"{label}.{k}" if label else str(k), keys, places, emit)


def strings(values: list) -> pa.Array:
    """An Arrow text array; half of a surrogate pair, which JSON can name but UTF-8 can't hold, becomes '?'."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def _text(value) -> str | None:
    return value if isinstance(value, str) or value is None else dumps(value)


def shred(df: DataFrame, key: str, line: str, paths: Sequence[str], carry: Sequence[str] = (), values: bool = False) -> DataFrame:
    """Flat nodes of the records in the text column `line`, one row a node.

    Columns: the key, `node_path` (one of paths), `dewey`, `keys` (object keys met at '*'), `places`
    (positions met at '[]'), each of `carry` (a field of the record's top as text), and with `values`
    `node_value` (text, or JSON text of what is not a text).

    A path's '*' takes every entry of an object, '[]' every element of an array; a lone value counts as
    an array of one. What isn't there, is null or has another shape gives no node; a null element keeps
    its place and gives a node. A line that isn't one whole JSON object (null, empty, framing, damaged,
    an error text) gives nothing. Repeated lines give their rows again. Other columns of df, whatever
    their names, aren't read.
    """
    trie = _trie(paths)
    n_paths = list(paths)
    carried = list(carry)
    key_type = df.schema[key].dataType
    fields = [T.StructField(key, key_type), T.StructField("node_path", T.StringType()), T.StructField("dewey", T.StringType()),
              T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("places", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(c, T.StringType()) for c in carried]
    fields += [T.StructField("node_value", T.StringType())] * values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(n_paths)
        rows: list[int] = []
        which: list[int] = []
        labels: list[str] = []
        flat_keys: list[str] = []
        key_ends: list[int] = [0]
        flat_places: list[int] = []
        place_ends: list[int] = [0]
        held: list[list] = [[] for _ in carried]
        texts: list = []

        def flush(keys: pa.Array) -> pa.RecordBatch:
            at = pa.array(rows, pa.int32())
            columns = [keys.take(at), names.take(pa.array(which, pa.int32())), pa.array(labels, pa.string()),
                       pa.ListArray.from_arrays(pa.array(key_ends, pa.int32()), strings(flat_keys)),
                       pa.ListArray.from_arrays(pa.array(place_ends, pa.int32()), pa.array(flat_places, pa.int32()))]
            columns += [strings(h) for h in held]
            columns += [strings(texts)] * values
            for x in (rows, which, labels, flat_keys, flat_places, texts, *held):
                x.clear()
            key_ends[:] = [0]
            place_ends[:] = [0]
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

        for batch in batches:
            keys = batch.column(0)
            for i, text in enumerate(batch.column(1).to_pylist()):
                record = read_object(text)
                if record is None:
                    continue
                top = [_text(record.get(c)) for c in carried]

                def emit(end, label, names_met, places_met, value, i=i, top=top):
                    rows.append(i)
                    which.append(end)
                    labels.append(label)
                    flat_keys.extend(names_met)
                    key_ends.append(len(flat_keys))
                    flat_places.extend(places_met)
                    place_ends.append(len(flat_places))
                    for h, v in zip(held, top):
                        h.append(v)
                    if values:
                        texts.append(_text(value))

                _walk(record, trie, "", (), (), emit)
                if len(rows) >= BATCH:
                    yield flush(keys)
            if rows:
                yield flush(keys)

    return df.select(key, line).mapInArrow(run, T.StructType(fields))


def parent_label(dewey: Column, steps: int = 1, depth: int | None = None) -> Column:
    """The label of the ancestor so many steps up; '' above the top. Labels of one schema path have one `depth`, by which they are
    cut faster."""
    if depth is not None:
        return F.substring_index(dewey, ".", depth - steps)
    return F.regexp_replace(dewey, rf"(^|\.)\d+(\.\d+){{{steps - 1}}}$", "")


def ordinal(dewey: Column) -> Column:
    """A node's place among its siblings: the last part of its label."""
    return F.substring_index(dewey, ".", -1).cast("int")


def node_tables(nodes: DataFrame, paths: Sequence[str]) -> dict[str, DataFrame]:
    """The nodes of each schema path as a table of its own."""
    return {p: nodes.filter(F.col("node_path") == p).drop("node_path") for p in paths}
