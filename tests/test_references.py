import datetime as dt

import pytest

from graphloom.functions.ids import bare_text
from graphloom.operators import references


def t(day, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


LOG = [(0, "Q1", "create", t(0)), (1, "Q1", "delete", t(40)), (2, "Q1", "create", t(0)), (3, "Q1", "restore", t(80)), (4, "Q2", "create", t(10)), (5, "Q3", "create", t(5)), (6, "Q3", "delete", t(5)), (7, None, "create", t(1)), (8, "Q4", None, t(3))]


def lifetimes(spark, rows):
    return references.lifetimes(spark.createDataFrame(rows, "log_id long, id string, act string, logged_at timestamp"), "id", "act", "logged_at", "log_id")


def test_lifetimes(spark):
    got = sorted((r["id"], r["since"], r["until"]) for r in lifetimes(spark, LOG).collect())
    assert got == [("Q1", t(0), t(40)), ("Q1", t(80), None), ("Q2", t(10), None), ("Q4", t(3), None)]
    assert lifetimes(spark, []).count() == 0


def test_orphans_in_time(spark):
    keys = lifetimes(spark, LOG).withColumnRenamed("id", "ref_id")
    refs = [(1, "Q1", t(-1)), (2, "Q1", t(0)), (3, "Q1", t(40)), (4, "Q1", t(81)), (5, "Q9", t(1)), (6, None, t(1)), (7, "Q2", None), (8, "Q9", None), (5, "Q9", t(1))]
    df = spark.createDataFrame(refs, "row_id long, ref_id string, at timestamp").withColumnRenamed("row_id", "since_row")
    got = sorted(r["since_row"] for r in references.orphans(df, keys, ["ref_id"], "simple", "at", "since", "until").collect())
    assert got == [1, 3, 5, 5, 8]


@pytest.mark.parametrize("match, want", [("simple", [4]), ("partial", [3, 4]), ("full", [2, 3, 4])])
def test_composite_keys_with_partial_nulls(spark, match, want):
    keys = spark.createDataFrame([("a", "x"), ("b", None)], "k1 string, k2 string")
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "z"), (4, "b", "x"), (5, None, None)], "n long, k1 string, k2 string")
    assert sorted(r["n"] for r in references.orphans(refs, keys, ["k1", "k2"], match).collect()) == want


def test_no_keys_and_bare_ids(spark):
    keys = spark.createDataFrame([], "k string")
    refs = spark.createDataFrame([(1, "a"), (2, None)], "n long, k string")
    assert [r["n"] for r in references.orphans(refs, keys, ["k"]).collect()] == [1]
    assert [bare_text(x) for x in (" wd:q12 ", "kg/entity/Q1", "", None, "x:")] == ["Q12", "Q1", None, None, None]


def test_hot_key_in_time_against_all_pairs(spark):
    import random

    rnd = random.Random(7)
    lives = []
    for i in range(600):
        a = rnd.randint(0, 4000)
        lives.append((rnd.choice(["hot", "hot", "a", "b", None]), t(0, 0) + dt.timedelta(hours=a), None if rnd.random() < 0.02 else t(0) + dt.timedelta(hours=a + rnd.randint(1, 30))))
    refs = [(i, rnd.choice(["hot", "hot", "a", "b", "none", None]), t(0) + dt.timedelta(hours=rnd.randint(-50, 4100)), "x") for i in range(1500)]
    keys = spark.createDataFrame(lives, "k string, since timestamp, until timestamp")
    df = spark.createDataFrame(refs, "n long, k string, at timestamp, until string")
    want = sorted(n for n, k, at, _ in refs if k is not None and not any(k == kk and a <= at and (b is None or at < b) for kk, a, b in lives if kk))
    for small in (False, True):
        got = references.orphans(df.withColumnRenamed("until", "other"), keys, ["k"], "simple", "at", "since", "until", small=small)
        assert got.columns == ["n", "k", "at", "other"] and sorted(r["n"] for r in got.collect()) == want
