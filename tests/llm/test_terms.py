import unicodedata
from collections import Counter

import regex

from graphloom.llm import terms

SCHEMA = "row_id long, enlabel string, frlabel string, fraliase array<string>, term string, n_occ string"


def brute(rows):
    occ, per = Counter(), Counter()
    for _, a, b, c, *_ in rows:
        found = []
        for v in (a, b, *(c or [])):
            if v:
                found += regex.findall(r"[\p{L}\p{N}\p{M}]+", unicodedata.normalize("NFKC", v).lower())
        occ.update(found)
        per.update(set(found))
    return {(t, occ[t], per[t]) for t in occ}


def count(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in terms.term_counts(df, ["enlabel", "frlabel", "fraliase"], **kw).collect()}


def test_against_brute_force_and_forced_splits(spark):
    rows = [(i, "Église du Pont", None, ["Ｐｏｎｔ 12²", None, f"nom{i % 97}"], "x", "y") for i in range(300)]
    rows += [(1, None, None, None, None, None), (2, "", "  ", [], "", ""), (3, "…!?", "é é é", ["İ"], "", ""), (3, "…!?", "é é é", ["İ"], "", "")]
    want = brute(rows)
    assert count(spark, rows) == want
    assert count(spark, rows, part_rows=60) == want


def test_empty_and_long(spark):
    assert count(spark, []) == set()
    assert count(spark, [(1, "a " * 200000, None, None, "", "")]) == {("a", 200000, 1)}


def test_split_follows_bits():
    parts, large = terms._split({0: 5, 1: 5, 2: 1, 3: 1, 7: 50}, 3, 8)
    assert large == [7] and {(p, b) for p, b in parts} == {(0, 3), (1, 3), (1, 2), (2, 2), (6, 3)}


def test_marks(spark):
    df = spark.createDataFrame([("a", 9, 2), ("b", 9, 5), ("c", 9, 4)], "term string, n_occ long, n_rows long")
    assert [r["mark"] for r in terms.marked(df, 100, common=0.04).orderBy("term").collect()] == ["rare", "common", None]


def test_hot_term_in_parts_of_one(spark):
    import glob

    rows = [(i, "pont", "pont", [f"n{i}"], "x", "y") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = {tuple(r) for r in terms.term_counts(df, ["enlabel", "frlabel", "fraliase"], part_rows=1).collect()}
    assert got == brute(rows) and ("pont", 800, 400) in got
    assert not glob.glob(".tmp*")
