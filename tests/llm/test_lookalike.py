import pytest

from graphloom.llm import lookalike

LATIN = ["château de Saumodôme", "Orbpimare station", "il y a", "The X & Y", "Kerville", "pêche", "Aigse", "cope"] * 5
OWN = ["озеро Сорва", "река Тарвинка", "ποταμός Λάμρινα", "みなみ図書館", "α star", "gare β de Pont", "km² n° 5…", "l’œuvre « x »", "сор", "ポンプ　ＡＢ"[:3]]


def off(spark, values):
    df = spark.createDataFrame([(i, v, None, [None, v]) for i, v in enumerate(values)], "row_id long, enlabel string, is_off string, fraliase array<string>")
    rows = lookalike.unify(df, "row_id", ["enlabel", "fraliase"]).collect()
    assert all(r["pos"] == (1 if r["field_name"] == "fraliase" else 0) for r in rows)
    return {values[r["row_id"]]: r["clean_value"] for r in rows if r["is_off"]}


def test_look_alikes(spark):
    cases = {"Ｃｏｒｐ　ｍｕｓｅｕｍ": "Corp museum", "école": "école", "Tal​fond﻿": "Talfond", "a b": "a b", "сhâtеаu": "château", "Vieux‑Pont": "Vieux-Pont", "Ⅴelre": "Velre", "ﬂuvial": "fluvial", "Kerville": "Kerville", "Opбск": "Орбск", "Έcole": "École", "lac Βr­asègny": "lac Brasègny", "de рау x": "de pay x", "Ｄｒ ２": "Dr 2"}
    got = off(spark, LATIN + OWN + list(cases) + ["Орбск"] * 3)
    assert got == cases


def test_look_alikes_compare_equal(spark):
    forms = ["Pont ancien", "Рont ancien", "Pont ancien", "Ｐont ancien", "Po‍nt ancien"]
    got = off(spark, forms + ["Pont ancien"] * 3)
    assert {got.get(f, f) for f in forms} == {"Pont ancien"}


def test_nothing_there(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", []), (3, "x" * 100000, [""])], "row_id long, a string, b array<string>")
    rows = lookalike.unify(df, "row_id", ["a", "b"]).collect()
    assert len(rows) == 3 and not any(r["is_off"] for r in rows)
    assert lookalike.unify(df.limit(0), "row_id", ["a", "b"]).count() == 0


@pytest.mark.parametrize("text", ["", "‍", "👩‍💻", "क्‍ष", "́", "퟿"])
def test_odd_texts(text):
    lookalike.Rewriter(*lookalike.rewriting(lookalike.look_alikes(set(text)), {}))(text)


def test_classes_are_transitive():
    c = lookalike.look_alikes(["Ａ", "А", "Α", "A", "é", "é", "x"])
    assert len({c.find(x) for x in "ＡАΑA"}) == 1 and c.find("é") == c.find("é")
