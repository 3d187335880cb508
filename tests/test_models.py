import io
import math
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.kb import KnowledgeBase
from graphloom.lang.shell import Shell
from graphloom.parsing import parser
from graphloom.parsing import vectors as V
from graphloom.parsing.parser import Machine, QuestionParser, actions, answers_by_shape
from graphloom.plans import model_queries
from graphloom.trees import tables
from graphloom.trees import tree as T


def vec(spark, d):
    return spark.createDataFrame([(list(x), y, w) for (x, y), w in d.items()], "x array<string>, y string, w double")


def as_dict(df):
    return {(tuple(r["x"]), r["y"]): r["w"] for r in df.collect()}


def test_vectors(spark, tmp_path):
    a, b = vec(spark, {(("a",), "l"): 1.0, (("b",), "l"): 2.0}), vec(spark, {(("b",), "l"): 3.0, (("c",), "l"): 1.0})
    delta = V.scale(V.sub(b, a), 0.7)
    assert V.dot(V.assign(a, b), a).first()["dot"] == pytest.approx(7.0)
    assert as_dict(delta)[("b",), "l"] == pytest.approx(0.7) and as_dict(V.neg(a))[("a",), "l"] == -1.0
    assert V.dot(a, vec(spark, {})).first()["dot"] == 0.0
    V.save(a, str(tmp_path / "w"))
    assert as_dict(V.load(spark, str(tmp_path / "w"))) == as_dict(a)
    with pytest.raises(ZeroDivisionError):
        V.div(a, 0)


def test_probabilities_and_no_parse(spark):
    df = spark.createDataFrame([(1, 0, 3.0, True), (1, 1, 1.0, False), (2, 0, 0.0, False)], "qid long, deriv int, score double, correct boolean")
    p = V.probabilities(df).cache()
    assert sorted((r["qid"], r["p"], r["status"]) for r in p.collect()) == [(1, 0.25, "ok"), (1, 0.75, "ok"), (2, 0.0, "no_parse")]
    assert V.log_likelihood(p).first()[0] == pytest.approx(math.log(0.75))
    feats = spark.createDataFrame([(1, 0, ["f"], "S", 1), (1, 1, ["f"], "S", 2)], "qid long, deriv int, x array<string>, y string, n int")
    assert as_dict(V.gradient(p, feats))[("f",), "S"] == pytest.approx(1 - 0.75 - 0.25 * 2)


TOKENS = [(1, 0, "Qui", "WHQ"), (1, 1, "est", None), (1, 2, "maire", "P6"), (1, 3, "Paris", "Q90"), (2, 0, "hein", None), (3, 0, "Qui", "WHQ"), (3, 1, "a", "Q1"), (3, 2, "et", "AND"), (3, 3, "b", "Q2")]


def test_parser(spark):
    tokens = spark.createDataFrame(TOKENS, "qid long, pos int, form string, macro string")
    d = QuestionParser(width=50).derivations(tokens).cache()
    terms = {r["term"] for r in d.filter("qid = 1 AND ltype = 't'").collect()}
    assert "(@exists (x:e) (exists (y:e) (and (wdt:P6 x y) (wd:Q90 y))))" in terms
    assert [r["status"] for r in d.filter("qid = 2").collect()] == ["no_parse"]
    assert "(@exists (x:e) (and (wd:Q1 x) (wd:Q2 x)))" in {r["term"] for r in d.filter("qid = 3 AND ltype = 't'").collect()}
    assert [a.label for a in actions()] == ["S", ">", "<", "D", "U", "U[SWAP]", ">[JOIN]", "<[JOIN]", "C[AND]", "C[OR]"]
    assert Machine().parse([], 5) == []


def test_training_raises_the_right_answer(spark):
    tokens = spark.createDataFrame([t for t in TOKENS if t[0] == 1], "qid long, pos int, form string, macro string")
    rows = [("Q7", "P6", "Q90"), ("Q90", "P6", "Q8")]
    kb = KnowledgeBase(spark.createDataFrame([(s, p, o, None, None, None) for s, p, o in rows], "s string, p string, o string, o_num double, o_str string, o_date date"))
    parser = QuestionParser(width=20)
    gold = spark.createDataFrame([(1, "Q7")], "qid long, answer string")
    history = parser.fit(tokens, lambda d: answers_by_shape(d, kb), gold, epochs=3, rate=0.5)
    assert history[-1] > history[0]
    best = parser.predict(tokens).first()
    assert {r[0] for r in kb.query(best["term"]).collect()} == {"Q7"}
    assert parser.weights_table(spark).count() == len(parser.weights)


TREE = "(S (NP-SBJ (N Jean)) (VP (V mange) (NP (D 3) (A x) (N y) (P z))) (-NONE- t))"


def test_tree_round_trips():
    t = T.read(TREE)
    assert str(t) == TREE and t.leaves() == ["Jean", "mange", "3", "x", "y", "z", "t"]
    for left in (True, False):
        assert T.unbinarize(T.markovize(t, left)) == t
        assert all(len(n.kids) <= 2 for n in [T.markovize(t, left)])
    assert T.expand_unaries(T.close_unaries(t)) == t
    assert [x.label for x in T.strip_tags(t).kids][:1] == ["NP-SBJ"]
    assert str(T.prepare(t)) == "(TOP (S (NP (N Jean)) (VP (V mange) (NP (D <num>) (A x) (N y) (P z)))))"
    assert T.strip_traces(T.read("(S (NP (-NONE- t)))")) is None
    assert T.compare(t, t) == (1.0, 1.0, 1.0) and T.compare(T.read("(A b)"), T.read("(C d)"))[2] == 0.0
    assert str(T.add_tags(T.read("(S a b)"), ["X", "Y"])) == "(S (X a) (Y b))"
    assert T.normalize_oov(T.read("(S a b)"), {"a"}, "u").leaves() == ["a", "u"]
    assert T.flatten(["(A\n", " (B c))\n", "\n", "(D e)"]) == ["(A (B c))", "(D e)"]
    for bad in ("(", "(A b", "a)", ")", "(A b) c"):
        with pytest.raises(T.TreeError):
            T.read(bad)


def test_tree_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, TREE, 2), (2, None, 3), (3, "(bad", 4), (4, "(S a)", 24)], "k long, t string, label int")
    nodes = tables.parse_trees(df, "k", "t").cache()
    assert {tuple(r) for r in tables.spans(nodes.filter("tree_id = 1")).select("leaf_lo", "leaf_hi", "label").collect()} == set(T.spans(T.read(TREE)))
    assert [r["form"] for r in tables.leaf_tokens(nodes.filter("tree_id = 1")).orderBy("pos").collect()] == T.read(TREE).leaves()
    assert {(r["pos"], r["tag"]) for r in tables.pos_tags(nodes.filter("tree_id = 1")).collect()} >= {(0, "N"), (1, "V")}
    assert tables.score(nodes, nodes).filter("f1 < 1").count() == 0
    assert df.select(tables.transformed(F.col("t"), T.prepare).alias("o")).filter("o IS NULL").count() == 2
    tables.write_split(df, "label", "t", str(tmp_path / "out"))
    assert {r["split"] for r in spark.read.json(str(tmp_path / "out")).collect()} == {"train", "dev"}
    (tmp_path / "mrg").mkdir()
    (tmp_path / "mrg" / "a.mrg").write_text("(A\n (B c))\n(D e)\n")
    assert [r["tree"] for r in tables.read_directory(spark, str(tmp_path / "mrg")).collect()] == ["(A (B c))", "(D e)"]


def test_shell():
    out = io.StringIO()
    s = Shell(stdout=out)
    assert s.onecmd("(+ 1 2)") is False and s.onecmd("(define X 4)") is False and s.onecmd("(* X X)") is False and s.onecmd("(") is False and s.onecmd("quit") is True
    assert out.getvalue().splitlines()[:2] == ["3.0 : num", "16.0 : num"]


def test_registered_parser_keeps_all_derivations(spark, tmp_path):
    rows = [(1, "Q1", 0, "alpha"), (2, "P2", 1, "beta"), (3, "Q3", 2, "alpha,beta,alpha")]
    spark.createDataFrame(rows, "row_id long, id string, rank_order int, frlabel string").write.parquet(str(tmp_path / "lexicon_base.parquet"))
    asked = [("Quel", "WHQ"), ("alpha", "Q1"), (",", None), ("beta", "P2"), (",", None), ("alpha", "Q1"), ("?", None)]
    tokens = spark.createDataFrame([(3, i, f, m) for i, (f, m) in enumerate(asked)], "qid long, pos int, form string, macro string")
    n = {w: QuestionParser(width=w).derivations(tokens).filter("status = 'ok'").count() for w in (20, 500)}
    p = {w: round(QuestionParser(width=w).predict(tokens).first()["p"], 6) for w in (20, 500)}
    got = {r["qid"]: r["p"] for r in model_queries.parse_questions(spark, str(tmp_path)).collect()}
    assert n == {20: 2, 500: 16} and got[3] == p[500] != p[20]


def test_equal_questions_are_parsed_once_a_task(spark, tmp_path, monkeypatch):
    at, parsed = tmp_path / "parsed", Machine.parse
    at.mkdir()

    def parse(self, tokens, width):
        (at / str(uuid.uuid4())).touch()
        return parsed(self, tokens, width)

    monkeypatch.setattr(Machine, "parse", parse)
    spark.range(600).selectExpr("id AS c_custkey", "CAST(id % 3 AS int) AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = model_queries.parse_weighted(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(i, f"(@exists (x:e) (exists (y:e) (and (wdt:P2 x y) (wd:Q200000000{i % 3} y))))", 0.333333) for i in range(600)} and len(got) == 600
    assert len(list(at.iterdir())) <= 3 * 4  # the questions of 3 nations in 4 tasks


@pytest.mark.parametrize("sent, known", [(20_000, 10_000), (7, 12), (1, 0)])
def test_equal_questions_have_their_own_rows(spark, monkeypatch, sent, known):
    monkeypatch.setattr(parser, "SENT", sent)
    monkeypatch.setattr(parser, "KNOWN", known)
    rows = [(q + 3 * i, pos, form, macro) for i in range(40) for q, pos, form, macro in TOKENS]
    tokens = spark.createDataFrame(rows, "qid long, pos int, form string, macro string")
    one = {q: [] for q in (1, 2, 3)}
    for r in QuestionParser(width=50).derivations(spark.createDataFrame(TOKENS, tokens.schema)).orderBy("deriv").collect():
        one[r["qid"]].append(r[1:])
    got = {q: [] for q in range(1, 121)}
    for r in QuestionParser(width=50).derivations(tokens).orderBy("deriv").collect():
        got[r["qid"]].append(r[1:])
    assert all(got[q] == one[(q - 1) % 3 + 1] for q in got) and len(one[1]) > 1 and one[2] == [(-1, 0.0, None, None, None, [], "no_parse", [], None)]
    some = QuestionParser(width=50).derivations(tokens, ["term", "deriv"])
    assert some.columns == ["qid", "term", "deriv"] and {tuple(r) for r in some.collect()} == {(q, x[3], x[0]) for q in got for x in got[q]}
