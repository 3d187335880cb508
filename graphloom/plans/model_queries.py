"""Queries of the term language's operators, sparse vectors, scoring, parsing and trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.kb import KnowledgeBase
from graphloom.kb.compiler import column_of
from graphloom.lang.parser import parse, standard_context
from graphloom.lang.terms import Lam, Var, substitute
from graphloom.parsing import vectors as V
from graphloom.parsing.parser import QuestionParser, answers_by_shape
from graphloom.session import cut, scratch, table
from graphloom.text import tokenizer
from graphloom.trees import tables
from graphloom.trees import tree as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def term_column(text: str, *columns: str):
    """A lambda term applied to columns, as a column."""
    term = parse(text, standard_context())
    for c in columns:
        assert isinstance(term, Lam)
        term = substitute(term.body, Var(c))
    return column_of(term)


@query("SELECT p_partkey, (p_size + 3.5) * 2 - p_size / 4 AS v FROM part")
def lang_arith(spark, d):
    return table(spark, d, "part").select("p_partkey", term_column("(lambda (x:num) (- (* (+ x 3.5) 2) (/ x 4)))", "p_size").alias("v"))


@query("SELECT p_partkey, (p_size > 20 AND NOT p_retailprice < 1000) OR p_size = 1 AS v FROM part")
def lang_bool(spark, d):
    return table(spark, d, "part").select("p_partkey", term_column("(lambda (x:num y:num) (or (and (> x 20) (not (< y 1000))) (== x 1)))", "p_size", "p_retailprice").alias("v"))


@query("SELECT p_partkey, p_size >= 10 AND p_size <= 30 AND p_size <> 20 AND p_brand < p_type AS v FROM part")
def lang_compare(spark, d):
    text = "(lambda (x:num a:s b:s) (and (>= x 10) (and (<= x 30) (and (!= x 20) (< a b)))))"
    return table(spark, d, "part").select("p_partkey", term_column(text, "p_size", "p_brand", "p_type").alias("v"))


@query("SELECT p_partkey, substr(p_name, 1, 1) AS head, substr(p_name, 2) AS rest, p_brand || p_type AS both_parts FROM part")
def lang_strings(spark, d):
    t = table(spark, d, "part")
    return t.select("p_partkey", term_column("(lambda (s:s) (CarS s))", "p_name").alias("head"), term_column("(lambda (s:s) (CdrS s))", "p_name").alias("rest"), term_column("(lambda (a:s b:s) (ConsS a b))", "p_brand", "p_type").alias("both_parts"))


_VEC_A = "SELECT l_returnflag AS a, l_linestatus AS b, CAST(l_linenumber AS VARCHAR) AS y, sum(l_discount) AS w FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL"
_VEC_B = "SELECT l_returnflag AS a, l_linestatus AS b, CAST(l_linenumber AS VARCHAR) AS y, sum(l_tax) AS w FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL"


def _vectors(spark, d):
    t = table(spark, d, "lineitem").select(F.array("l_returnflag", "l_linestatus").alias("x"), F.col("l_linenumber").cast("string").alias("y"), "l_linenumber", "l_discount", "l_tax")
    a = t.filter("l_linenumber <= 5").groupBy("x", "y").agg(F.sum("l_discount").alias("w"))
    return a, t.filter("l_linenumber >= 3").groupBy("x", "y").agg(F.sum("l_tax").alias("w"))


def _flat(v: DataFrame) -> DataFrame:
    return v.select(F.array_join("x", "|").alias("x"), "y", F.round("w", 6).alias("w"))


def _both(op: str) -> str:
    return f"SELECT coalesce(p.a, q.a) || '|' || coalesce(p.b, q.b) AS x, coalesce(p.y, q.y) AS y, round(coalesce(p.w, 0) {op} coalesce(q.w, 0), 6) AS w FROM ({_VEC_A}) p FULL JOIN ({_VEC_B}) q ON p.a = q.a AND p.b = q.b AND p.y = q.y"


@query(_both("+"))
def vec_add(spark, d):
    return _flat(V.add(*_vectors(spark, d)))


@query(_both("-"))
def vec_sub(spark, d):
    return _flat(V.sub(*_vectors(spark, d)))


@query(f"SELECT a || '|' || b AS x, y, round(w * 0.7, 6) AS w FROM ({_VEC_A})")
def vec_scale(spark, d):
    return _flat(V.scale(_vectors(spark, d)[0], 0.7))


@query(f"SELECT a || '|' || b AS x, y, round(w / 3, 6) AS w FROM ({_VEC_A})")
def vec_div(spark, d):
    return _flat(V.div(_vectors(spark, d)[0], 3))


@query(f"SELECT a || '|' || b AS x, y, round(-w, 6) AS w FROM ({_VEC_A})")
def vec_neg(spark, d):
    return _flat(V.neg(_vectors(spark, d)[0]))


@query(f"SELECT round(sum(p.w * q.w), 4) AS dot FROM ({_VEC_A}) p JOIN ({_VEC_B}) q ON p.a = q.a AND p.b = q.b AND p.y = q.y")
def vec_dot(spark, d):
    return V.dot(*_vectors(spark, d)).select(F.round("dot", 4).alias("dot"))


@query(f"SELECT coalesce(q.a, p.a) || '|' || coalesce(q.b, p.b) AS x, coalesce(q.y, p.y) AS y, round(coalesce(q.w, p.w), 6) AS w FROM ({_VEC_A}) p FULL JOIN ({_VEC_B}) q ON p.a = q.a AND p.b = q.b AND p.y = q.y")
def vec_assign(spark, d):
    return _flat(V.assign(*_vectors(spark, d)))


@query(f"SELECT q.a || '|' || q.b AS x, q.y AS y, round(coalesce(p.w, 0), 6) AS w FROM ({_VEC_B}) q LEFT JOIN ({_VEC_A}) p ON p.a = q.a AND p.b = q.b AND p.y = q.y")
def vec_lookup(spark, d):
    a, b = _vectors(spark, d)
    return _flat(V.lookup(b.select("x", "y"), a))


_DERIV = "SELECT l_orderkey AS qid, l_linenumber AS deriv, exp(l_discount * 10) AS score, l_returnflag = 'R' AS correct FROM lineitem"
_P = f"SELECT *, score / sum(score) OVER (PARTITION BY qid) AS p FROM ({_DERIV})"


def _derivations(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("deriv"), F.exp(F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").alias("correct"))


@query(f"SELECT qid, deriv, round(p, 6) AS p FROM ({_P})")
def crf_probabilities(spark, d):
    return V.probabilities(_derivations(spark, d)).select("qid", "deriv", F.round("p", 6).alias("p"))


@query(f"""WITH d AS (SELECT *, greatest(1, sum(correct::INT) OVER (PARTITION BY qid)) AS c FROM ({_P})),
f AS (SELECT l_orderkey AS qid, l_linenumber AS deriv, l_linestatus AS x, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT x, y, round(sum((correct::INT - c * p) * n), 4) AS w FROM d JOIN f USING (qid, deriv) GROUP BY ALL""")
def crf_gradient(spark, d):
    features = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("deriv"), F.array("l_linestatus").alias("x"), F.col("l_returnflag").alias("y")).agg(F.count("*").alias("n"))
    return V.gradient(V.probabilities(_derivations(spark, d)), features).select(F.array_join("x", "|").alias("x"), "y", F.round("w", 4).alias("w"))


@query(f"SELECT round(avg(correct::INT), 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(p, 12) DESC, deriv, correct DESC) AS r FROM ({_P})) WHERE r = 1")
def crf_accuracy(spark, d):
    p = V.probabilities(_derivations(spark, d)).withColumn("p", F.round("p", 12))
    return V.accuracy(p, F.struct(-F.col("deriv"), "correct")).select(F.round("accuracy", 6).alias("accuracy"))


@query(f"SELECT qid, deriv, place FROM (SELECT qid, deriv, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, deriv) AS place FROM ({_DERIV})) WHERE place <= 3")
def crf_beam_topk(spark, d):
    return V.beam_top(_derivations(spark, d).withColumn("score", F.round("score", 9)), ["qid"], "score", "deriv", 3).select("qid", "deriv", "place")


@query()
def parse_questions(spark, d):
    """Short questions over the lexicon, parsed to terms: the most probable one of each."""
    lex = table(spark, d, "lexicon_base").select(F.col("frlabel").alias("named_entity"), "id", F.col("rank_order").alias("rank"))
    asked = table(spark, d, "lexicon_base").filter("frlabel IS NOT NULL AND id LIKE 'Q%'").select("row_id", F.concat(F.lit("Quel "), "frlabel", F.lit(" ?")).alias("question"))
    tokens = tokenizer.link(tokenizer.tokenize(asked, "row_id", "question", lex.filter("named_entity IS NOT NULL")), lex).withColumnRenamed("row_id", "qid")
    return QuestionParser().predict(tokens).select("qid", "term", F.round("p", 6).alias("p"))


_ASKED = "SELECT c_custkey AS qid, 'Q2' || lpad(c_nationkey::VARCHAR, 9, '0') AS q FROM customer"


def _asked(spark, d):
    """A question for every customer."""
    return _tokens(table(spark, d, "customer"))


def _tokens(t: DataFrame) -> DataFrame:
    """Tokens of questions 'Quel P2 <nation>': which customers are of it."""
    t = t.select(F.col("c_custkey").alias("qid"), F.concat(F.lit("Q2"), F.lpad(F.col("c_nationkey").cast("string"), 9, "0")).alias("q"))
    words = F.array(*(F.struct(F.lit(i).alias("pos"), form.alias("form"), macro.alias("macro")) for i, (form, macro) in enumerate([(F.lit("Quel"), F.lit("WHQ")), (F.lit("client"), F.lit("P2")), (F.col("q"), F.col("q"))])))
    return t.select("qid", F.explode(words).alias("w")).select("qid", "w.*")


# what the grammar makes of the three tokens, each derivation once: type, term, its actions and their display
_DERIVED = """SELECT qid, unnest(l, recursive := true) FROM (SELECT qid, [
  {'ltype': 'function', 'term': '(lambda (P:e=>t) (@exists (x:e) (P x)))', 'steps': 'S D D', 'display': '(S Quel)'},
  {'ltype': 'function', 'term': 'wdt:P2', 'steps': 'D S D', 'display': '(S client)'},
  {'ltype': '⊥', 'term': 'wdt:P2', 'steps': 'D U D', 'display': '(U client)'},
  {'ltype': 'function', 'term': '(lambda (x:e) (lambda (y:e) (wdt:P2 y x)))', 'steps': 'D U[SWAP] D', 'display': '(U[SWAP] client)'},
  {'ltype': 'function', 'term': 'wd:' || q, 'steps': 'D D S', 'display': '(S ' || q || ')'},
  {'ltype': 'function', 'term': '(lambda (x:e) (exists (y:e) (and (wdt:P2 x y) (wd:' || q || ' y))))', 'steps': 'D S S >[JOIN]', 'display': '(>[JOIN] (S client) (S ' || q || '))'},
  {'ltype': 'function', 'term': '(lambda (x:e) (exists (y:e) (and (wdt:P2 y x) (wd:' || q || ' y))))', 'steps': 'D U[SWAP] S >[JOIN]', 'display': '(>[JOIN] (U[SWAP] client) (S ' || q || '))'},
  {'ltype': 't', 'term': '(@exists (x:e) (wd:' || q || ' x))', 'steps': 'S D S >', 'display': '(> (S Quel) (S ' || q || '))'},
  {'ltype': 't', 'term': '(@exists (x:e) (exists (y:e) (and (wdt:P2 x y) (wd:' || q || ' y))))', 'steps': 'S S S >[JOIN] >', 'display': '(> (S Quel) (>[JOIN] (S client) (S ' || q || ')))'},
  {'ltype': 't', 'term': '(@exists (x:e) (exists (y:e) (and (wdt:P2 y x) (wd:' || q || ' y))))', 'steps': 'S U[SWAP] S >[JOIN] >', 'display': '(> (S Quel) (>[JOIN] (U[SWAP] client) (S ' || q || ')))'}] AS l FROM (""" + _ASKED + "))"


@query(_DERIVED)
def parse_derivations(spark, d):
    """All derivations of short questions with the actions that lead to them and the trees that show them."""
    got = QuestionParser().derivations(_asked(spark, d)).filter("status = 'ok'")
    return got.select("qid", "ltype", "term", F.array_join("steps", " ").alias("steps"), "display")


@query(f"SELECT qid, s[i] AS y, count(*) AS n FROM (SELECT qid, string_split(steps, ' ') AS s FROM ({_DERIVED})), (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE i <= len(s) GROUP BY ALL")
def parse_actions(spark, d):
    """How often each action is taken in a question's derivations, from their feature vectors: three features at each step."""
    got = QuestionParser().derivations(_asked(spark, d)).select("qid", "deriv", F.explode("features").alias("f")).select("qid", "deriv", "f.*")
    ahead = got.filter(F.get("x", F.lit(0)) == "B")  # one feature a step looks ahead
    return ahead.groupBy("qid", "y").agg(F.sum("n").alias("n"))


@query(f"SELECT x, y, count(*) AS n FROM (SELECT CASE i WHEN 1 THEN 'B|Quel|client' WHEN 2 THEN 'B|client|' || q WHEN 3 THEN 'B|' || q || '|#END#' ELSE 'B|#END#' END AS x, s[i] AS y FROM (SELECT a.q, string_split(steps, ' ') AS s FROM ({_DERIVED}) JOIN ({_ASKED}) a USING (qid)), (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE i <= len(s)) GROUP BY ALL")
def parse_features(spark, d):
    """Features of the tokens ahead, with the action taken, over all derivations."""
    got = QuestionParser().derivations(_asked(spark, d)).select(F.explode("features").alias("f")).select("f.*").filter(F.get("x", F.lit(0)) == "B")
    return got.groupBy(F.array_join("x", "|").alias("x"), "y").agg(F.sum("n").alias("n"))


@query(f"SELECT qid, term, 0.333333 AS p FROM (SELECT qid, '(@exists (x:e) (exists (y:e) (and (wdt:P2 x y) (wd:' || q || ' y))))' AS term FROM ({_ASKED}))")
def parse_weighted(spark, d):
    """The best derivation under weights that favour shifting everything and joining; probabilities among the derivations of type t."""
    heavy = {(("B", "#END#"), ">[JOIN]"): 0.0, (("S", "#START#"), "S"): 3.0}
    parser = QuestionParser(heavy)
    got = V.probabilities(cut(parser.derivations(_asked(spark, d), ["score", "ltype", "term", "steps"]).filter("ltype = 't'")))
    # all three shift the question word first, so they share what it brings
    best = got.filter(F.array_join("steps", " ") == "S S S >[JOIN] >")
    return best.select("qid", "term", F.round("p", 6).alias("p"))


@query("SELECT c_nationkey AS qid, 'Q' || (3000000000 + c_custkey) AS answer FROM customer")
def parse_answers(spark, d):
    """Answers of a question on every nation, from the derivation 'which x has P2 y, y being the nation', all in one join."""
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_custkey"), F.col("n_nationkey").alias("c_nationkey"))
    derived = QuestionParser().derivations(_tokens(t)).filter(F.array_join("steps", " ") == "S S S >[JOIN] >")
    return answers_by_shape(derived.select("qid", "deriv", "term", "shape"), KnowledgeBase.from_tables(spark, d)).select("qid", "answer")


@query("SELECT c_custkey AS qid, 'no_parse' AS status, -1 AS deriv FROM customer")
def parse_failures(spark, d):
    """Questions without any word that means something have no parse."""
    words = _asked(spark, d).withColumn("macro", F.lit(None).cast("string"))
    return QuestionParser().derivations(words).select("qid", "status", "deriv")


@query("SELECT l_returnflag || '|' || l_linestatus AS x, CAST(l_linenumber AS VARCHAR) AS y, round(sum(CASE WHEN l_linenumber <= 5 THEN l_discount ELSE 0 END) + 0.5 * sum(CASE WHEN l_linenumber >= 3 THEN l_tax ELSE 0 END), 6) AS w FROM lineitem GROUP BY ALL")
def crf_step(spark, d):
    a, b = _vectors(spark, d)
    return _flat(V.step(a, b, 0.5))


@query(f"SELECT round(sum(ln(p)), 4) AS log_likelihood FROM ({_P}) WHERE correct")
def crf_log_likelihood(spark, d):
    return V.log_likelihood(V.probabilities(_derivations(spark, d))).select(F.round("log_likelihood", 4).alias("log_likelihood"))


def _trees(spark, d):
    t = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.select("n_nationkey", F.concat(F.lit("(S (NP-SBJ (N "), "n_name", F.lit(")) (VP (V in) (NP (D the) (N "), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("))) (CD "), F.col("n_nationkey").cast("string"), F.lit(",5))")).alias("tree"))


def _nodes(spark, d):
    return tables.parse_trees(_trees(spark, d), "n_nationkey", "tree")


@query("SELECT 'S' AS label, count(*) AS n FROM nation UNION ALL SELECT 'VP', count(*) FROM nation UNION ALL SELECT 'NP', count(*) FROM nation UNION ALL SELECT 'NP-SBJ', count(*) FROM nation")
def tree_category_counts(spark, d):
    return tables.category_counts(_nodes(spark, d))


@query("""SELECT n_nationkey AS tree_id, lo AS leaf_lo, hi AS leaf_hi, label FROM (
  SELECT n_nationkey, unnest([0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]) AS lo, unnest([5, 1, 1, 1, 4, 2, 2, 4, 3, 3, 4, 4, 5, 5]) AS hi,
  unnest(['S', 'NP-SBJ', 'N', n_name, 'VP', 'V', 'in', 'NP', 'D', 'the', 'N', replace(r_name, ' ', '_'), 'CD', n_nationkey || ',5']) AS label FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def tree_spans(spark, d):
    return tables.spans(_nodes(spark, d))


@query("SELECT n_nationkey AS tree_id, round(11 / 13.0, 6) AS prec, round(11 / 14.0, 6) AS recall, round(22 / 27.0, 6) AS f1 FROM nation")
def tree_prf(spark, d):
    got = _trees(spark, d).select("n_nationkey", F.regexp_replace(F.regexp_replace("tree", r"\(VP \(V in\) ", "(X (Y in) "), r"\(CD ([0-9]+,5)\)", "$1").alias("tree"))
    scores = tables.score(_nodes(spark, d), tables.parse_trees(got, "n_nationkey", "tree"))
    return scores.select("tree_id", *(F.round(c, 6).alias(c) for c in ("prec", "recall", "f1")))


@query("SELECT n_nationkey, '(TOP (S (NP (N ' || n_name || ')) (VP (V in) (NP (D the) (N ' || replace(r_name, ' ', '_') || '))) (CD <num>)))' AS tree FROM nation JOIN region ON n_regionkey = r_regionkey")
def tree_normalize_numbers(spark, d):
    return _trees(spark, d).select("n_nationkey", tables.transformed(F.col("tree"), T.prepare).alias("tree"))


@query("SELECT n_nationkey AS tree_id, p AS pos, CASE WHEN f IN ('in', 'the') THEN f ELSE '<unk>' END AS form FROM (SELECT n_nationkey, unnest([0, 1, 2, 3, 4]) AS p, unnest([n_name, 'in', 'the', replace(r_name, ' ', '_'), n_nationkey || ',5']) AS f FROM nation JOIN region ON n_regionkey = r_regionkey)")
def tree_oov(spark, d):
    lex = spark.createDataFrame([("in",), ("the",)], "form string")
    return tables.oov(tables.leaf_tokens(_nodes(spark, d)), lex)


@query("SELECT n_nationkey AS tree_id, p AS pos, f AS form, t AS tag FROM (SELECT n_nationkey, unnest([0, 1, 2, 3, 4]) AS p, unnest([n_name, 'in', 'the', replace(r_name, ' ', '_'), n_nationkey || ',5']) AS f, unnest(['N', 'V', 'D', 'N', 'CD']) AS t FROM nation JOIN region ON n_regionkey = r_regionkey)")
def tree_pos_tags(spark, d):
    return tables.pos_tags(_nodes(spark, d))


@query("SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 2 AND 21 THEN 'train' WHEN n_nationkey = 24 THEN 'dev' WHEN n_nationkey = 23 THEN 'test' END AS split FROM nation")
def tree_split(spark, d):
    return _trees(spark, d).select("n_nationkey", tables.split_of(F.col("n_nationkey")).alias("split"))


@query("SELECT n_nationkey, '(S (S: (NP-SBJ (N ' || n_name || ')) (VP (V in) (NP (D the) (N ' || replace(r_name, ' ', '_') || ')))) (CD ' || n_nationkey || ',5))' AS left_tree, '(S (NP-SBJ@N ' || n_name || ') (VP (V in) (NP (D the) (N ' || replace(r_name, ' ', '_') || '))) (CD ' || n_nationkey || ',5))' AS closed FROM nation JOIN region ON n_regionkey = r_regionkey")
def tree_markovize(spark, d):
    return _trees(spark, d).select("n_nationkey", tables.transformed(F.col("tree"), T.markovize).alias("left_tree"), tables.transformed(F.col("tree"), T.close_unaries).alias("closed"))


_LEAVES = "n_nationkey, n_name AS a, replace(r_name, ' ', '_') AS b FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT n_nationkey, '(S (NP-SBJ ' || a || ') (VP in (NP the ' || b || ')) ' || n_nationkey || ',5)' AS stripped, '(S (NP-SBJ (T0 ' || a || ')) (VP (T1 in) (NP (T2 the) (T3 ' || b || '))) (T4 ' || n_nationkey || ',5))' AS tagged FROM (SELECT {_LEAVES})")
def tree_tags(spark, d):
    """Trees without their tags, and with others put above the leaves."""
    tag = lambda t: T.add_tags(T.strip_tags(t), (f"T{i}" for i in range(9)))
    return _trees(spark, d).select("n_nationkey", tables.transformed(F.col("tree"), T.strip_tags).alias("stripped"), tables.transformed(F.col("tree"), tag).alias("tagged"))


@query(f"SELECT n_nationkey, '(S (NP-SBJ (N ' || a || ')) (S: (VP (V in) (NP (D the) (N ' || b || '))) (CD ' || n_nationkey || ',5)))' AS right_tree, true AS same_again, true AS opened_again FROM (SELECT {_LEAVES})")
def tree_binary_and_back(spark, d):
    """Right-branching trees; what was made binary or closed comes back as it was."""
    right = tables.transformed(F.col("tree"), lambda t: T.markovize(t, left=False))
    back = tables.transformed(F.col("tree"), lambda t: T.unbinarize(T.markovize(t, left=False)))
    again = tables.transformed(F.col("tree"), lambda t: T.expand_unaries(T.close_unaries(t)))
    return _trees(spark, d).select("n_nationkey", right.alias("right_tree"), (back == F.col("tree")).alias("same_again"), (again == F.col("tree")).alias("opened_again"))


@query(f"SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '(S (NP (N ' || a || ')) (NP (N ' || b || ')))' ELSE '(S (NP (N ' || a || ')))' END AS tree FROM (SELECT {_LEAVES})")
def tree_traces(spark, d):
    """Trees without traces and what they leave empty, labels without decoration."""
    t = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    other = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("(NP=2 (N "), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("))"))).otherwise("(VP (NP (-NONE- *T*)))")
    text = F.concat(F.lit("(S (NP-SBJ-1 (N "), "n_name", F.lit(")) "), other, F.lit(")"))
    return t.select("n_nationkey", tables.transformed(text, lambda x: T.strip_decoration(T.strip_traces(x))).alias("tree"))


@query(f"SELECT '(S (NP ' || a || ') (CD ' || n_nationkey || '))' AS tree, CASE WHEN n_nationkey BETWEEN 2 AND 21 THEN 'train' WHEN n_nationkey = 24 THEN 'dev' WHEN n_nationkey = 23 THEN 'test' END AS split, a || ' ' || n_nationkey AS raw FROM (SELECT {_LEAVES}) WHERE n_nationkey BETWEEN 2 AND 21 OR n_nationkey IN (23, 24)")
def tree_directory(spark, d):
    """A directory of trees that run over lines, read, flattened, and written and read by split."""
    at, out = scratch(spark), scratch(spark)
    rows = table(spark, d, "nation").select(F.concat(F.lit("(S\n  (NP "), "n_name", F.lit(")\n  (CD "), F.col("n_nationkey").cast("string"), F.lit("))")).alias("v"))
    rows.repartition(3).write.text(at)
    trees = tables.read_directory(spark, at).select("tree", F.regexp_extract("tree", r"\(CD (\d+)\)", 1).cast("int").alias("n"))
    tables.write_split(trees, "n", "tree", out)
    return spark.read.schema("tree string, raw string, split string").json(out)
