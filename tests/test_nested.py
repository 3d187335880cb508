import json

from pyspark.sql import functions as F

from graphloom.operators import nested
from graphloom.plans.data import DUMP_PATHS
from graphloom.plans import data

ITEM = {
    "id": "Q1", "labels": {"en": {"value": "a"}, "fr": {"value": "b"}}, "aliases": {"fr": [{"value": "c"}, None], "de": {"value": "lone"}, "ja": []},
    "sitelinks": {"enwiki": {"title": "a"}}, "claims": {"P31": [{"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}, "qualifiers": {"P1": [{"snaktype": "novalue"}, {"datavalue": {"value": "x"}}]}}], "P2": {"mainsnak": None}},
}


def found(spark, tmp_path, lines):
    rows = [(i, "d", None, line) for i, line in enumerate(lines)]
    spark.createDataFrame(rows, "line_no long, dump_name string, read_at timestamp, line string").write.parquet(f"{tmp_path}/dump_lines.parquet")
    return sorted(tuple(r) for r in data.p2_found(spark, str(tmp_path)).collect())


def test_sections_positions_and_lone_objects(spark, tmp_path):
    got = found(spark, tmp_path, ["[", "  " + json.dumps(ITEM) + ",\r", "]"])
    assert got == sorted([
        (1, "labels", "en", 0, "", -1), (1, "labels", "fr", 0, "", -1), (1, "sitelinks", "enwiki", 0, "", -1),
        (1, "aliases", "fr", 0, "", -1), (1, "aliases", "fr", 1, "", -1), (1, "aliases", "de", 0, "", -1),
        (1, "claims", "P31", 0, "", -1), (1, "claims", "P2", 0, "", -1), (1, "qualifiers", "P31", 0, "P1", 0), (1, "qualifiers", "P31", 0, "P1", 1)])


def test_damaged_empty_and_repeated_lines(spark, tmp_path):
    line = '{"labels": {"en": {"value": "x"}}, "aliases": [], "claims": null, "sitelinks": []}'
    got = found(spark, tmp_path, [None, "", "   ", line[:-3], line + " x", line + line, "503 error", "[1]", '"s"', line, line + ",", "﻿" + line, '{"labels": {"en": "\\ud83d"}}'])
    assert got == [(9, "labels", "en", 0, "", -1), (10, "labels", "en", 0, "", -1), (12, "labels", "en", 0, "", -1)]


def test_empty_table_and_long_line(spark, tmp_path):
    assert found(spark, tmp_path / "a", []) == []
    many = {"claims": {"P1": [{"mainsnak": {}}] * 70000}}
    assert len(found(spark, tmp_path / "b", [json.dumps(many)])) == 70000


def test_parent_links_by_truncation(spark):
    df = spark.createDataFrame([(7, json.dumps(ITEM), "x")], "line_no long, line string, keys string")
    nodes = nested.shred(df, "line_no", "line", DUMP_PATHS, ["id"], values=True)
    tables = nested.node_tables(nodes, DUMP_PATHS)
    claims = tables["claims.*[]"].select(F.col("dewey").alias("parent"), F.get("keys", F.lit(0)).alias("prop"))
    quals = tables["claims.*[].qualifiers.*[]"].withColumn("parent", nested.parent_label(F.col("dewey"), 3))
    assert {(r["prop"], r["id"]) for r in quals.join(claims, "parent").collect()} == {("P31", "Q1")}
    assert json.loads(tables["labels.*"].first()["node_value"]) == {"value": "a"}


def test_any_depth(spark):
    from graphloom.operators.nested import _deep_loads, dumps, loads

    for text in ('{"a": [1, -2.5e3, "x\\u00e9", true, null, {}, [], {"b": {"c": []}}], "d": ""}', ' [ ] ', '"x"', "12", '{"a":1,"a":2}'):
        assert _deep_loads(text) == json.loads(text) and json.loads(dumps(_deep_loads(text))) == json.loads(text)
    for bad in ("", "[1,]", "{", "[", "[1 2]", '{"a" 1}', '{"a":1,}', "[1]]", "tru", "01", '{a:1}', '"x'):
        try:
            _deep_loads(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    deep = "[" * 20000 + "]" * 20000
    assert dumps(loads(deep)).replace(" ", "") == deep
    line = '{"id": "Q1", "labels": {"fr": {"value": "x"}}, "extra": ' + '{"a":' * 20000 + "1" + "}" * 20000 + "},"
    df = spark.createDataFrame([(1, line)], "line_no long, line string")
    got = nested.shred(df, "line_no", "line", ["labels.*", "extra"], values=True).collect()
    assert {r["node_path"] for r in got} == {"labels.*", "extra"} and max(len(r["node_value"]) for r in got) > 100000
