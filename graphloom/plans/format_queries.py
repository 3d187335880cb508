"""Queries that write a format and read it back, run the whole pipeline, or go through the language's errors and hooks."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from graphloom import sources
from graphloom.etl import dump, lexicon, pipeline
from graphloom.graph import rank
from graphloom.kb import KnowledgeBase
from graphloom.lang.parser import TermSyntaxError, parse, standard_context
from graphloom.lang.terms import evaluate, is_closed, normalise, show, typecheck
from graphloom.lang.types import NUM, TypeFailure, arrow, show_type
from graphloom.parsing import vectors as V
from graphloom.plans.etl_queries import _BASE, _CHAIN, _ENTITIES, _PAGERANK
from graphloom.session import scratch, table
from graphloom.text import functions as T
from graphloom.text import tokenizer
from graphloom.text.tokenizer import Trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(r"SELECT line, count(*) AS n FROM (SELECT unnest(string_split_regex(line, '\r\n|\n|\r')) AS line FROM dump_lines) WHERE line <> '' GROUP BY line")
def src_dump_bz2(spark, d):
    """The dump written as bz2 and read again line by line."""
    at = scratch(spark)
    table(spark, d, "dump_lines").select("line").write.option("compression", "bzip2").text(at)
    return sources.read_dump(spark, at).filter("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


@query(r"SELECT regexp_replace(id, '\s+', '', 'g') AS id, score FROM rank_scores WHERE regexp_replace(id, '\s+', '', 'g') <> '' AND score IS NOT NULL")
def src_rank_file(spark, d):
    at = scratch(spark)
    sources.write_scores(table(spark, d, "rank_scores").select(F.regexp_replace("id", r"\s+", "").alias("id"), "score").filter("id <> '' AND score IS NOT NULL"), at)
    return sources.read_scores(spark, at)


_NODES = "SELECT id, row_number() OVER (ORDER BY id) - 1 AS node FROM (SELECT DISTINCT unnest(path_ids) AS id FROM statement_paths) WHERE id IS NOT NULL"


@query(f"SELECT * FROM ({_NODES})")
def src_id_index(spark, d):
    at = scratch(spark)
    sources.write_index(rank.node_index(table(spark, d, "statement_paths")), at)
    return sources.read_index(spark, at)


@query(f"WITH n AS ({_NODES}), e AS (SELECT DISTINCT * FROM ({_CHAIN}) WHERE src IS NOT NULL AND dst IS NOT NULL) SELECT a.node AS src, b.node AS dst FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst")
def src_edge_file(spark, d):
    """The edges as numbers of nodes, written and read."""
    paths, at = table(spark, d, "statement_paths"), scratch(spark)
    sources.write_edges(rank.number_edges(rank.edges(paths), rank.node_index(paths)), at)
    return sources.read_edges(spark, at)


@query(r"SELECT array_to_string(path_ids, ' ') AS path, count(*) AS n FROM statement_paths WHERE len(path_ids) BETWEEN 3 AND 5 AND NOT list_contains(list_transform(path_ids, lambda x: x IS NULL OR regexp_matches(x, '\s')), true) GROUP BY path")
def src_path_file(spark, d):
    at = scratch(spark)
    sources.write_paths(table(spark, d, "statement_paths"), at)
    return sources.read_paths(spark, at).groupBy(F.array_join("path_ids", " ").alias("path")).agg(F.count("*").alias("n"))


@query("SELECT ent_idx, qlabels, count(*) AS n FROM entity_stats WHERE octet_length(encode(coalesce(qlabels, ''))) <= 9000 GROUP BY ALL")
def src_entity_store(spark, d):
    """The entity table, put into the store in two parts."""
    rows, at = table(spark, d, "entity_stats").filter(F.octet_length(F.coalesce("qlabels", F.lit(""))) <= sources.ENTITY_WIDTHS["qlabels"]), scratch(spark)
    sources.write_entities(rows.filter("row_id % 2 = 0"), at)
    sources.write_entities(rows.filter("row_id % 2 = 1"), at)
    return sources.read_entities(spark, at).groupBy("ent_idx", "qlabels").agg(F.count("*").alias("n"))


@query("SELECT max(octet_length(encode(qlabels)))::INT AS most_bytes FROM entity_stats")
def etl_longest_labels(spark, d):
    return dump.longest_labels(table(spark, d, "entity_stats"))


@query("SELECT row_id, id, frlabel FROM lexicon_base")
def src_json_lines(spark, d):
    at = scratch(spark)
    sources.write_json_lines(table(spark, d, "lexicon_base").select("row_id", "id", "frlabel"), at)
    return spark.read.schema("row_id long, id string, frlabel string").json(at)


_KEYS = "SELECT named_entity, id, row_number() OVER (PARTITION BY named_entity ORDER BY o, id) - 1 AS rank FROM (SELECT enlabel AS named_entity, id, min(rank_order) AS o FROM lexicon_base WHERE enlabel IS NOT NULL AND trim(id) = id GROUP BY ALL)"


def _keys(spark, d):
    rows = table(spark, d, "lexicon_base").filter("enlabel IS NOT NULL AND trim(id) = id").groupBy(F.col("enlabel").alias("named_entity"), "id").agg(F.min("rank_order").alias("o"))
    return rows.groupBy("named_entity").agg(F.array_sort(F.collect_list(F.struct("o", "id"))).alias("x")).select("named_entity", F.posexplode("x").alias("pos", "x")).select("named_entity", "pos", "x.id")


@query(f"WITH k AS ({_KEYS}), b AS (SELECT id, any_value(bridging) AS bridging FROM (SELECT id, ['P' || (min(rank_order) % 7 + 1)] AS bridging FROM lexicon_base GROUP BY id) GROUP BY id) SELECT named_entity, k.id, rank, array_to_string(b.bridging, ' ') AS bridging FROM k JOIN b ON b.id = k.id")
def src_lexicon_json(spark, d):
    at = scratch(spark)
    bridging = table(spark, d, "lexicon_base").groupBy("id").agg(F.array(F.concat(F.lit("P"), (F.min("rank_order") % 7 + 1).cast("string"))).alias("bridging"))
    lexicon.write_json(_keys(spark, d), bridging, at)
    return tokenizer.read_lexicon_json(spark, at).select("named_entity", "id", "rank", F.array_join("bridging", " ").alias("bridging"))


@query(rf"SELECT named_entity, id, rank FROM ({_KEYS}) WHERE named_entity NOT LIKE '%:::%' AND trim(named_entity) = named_entity AND named_entity <> '' AND NOT regexp_matches(named_entity, '[\r\n]')")
def src_lexicon_text(spark, d):
    at = scratch(spark)
    keys = _keys(spark, d).filter("named_entity NOT LIKE '%:::%' AND trim(named_entity) = named_entity AND named_entity <> ''").filter(~F.col("named_entity").rlike("[\r\n]"))
    lines = keys.groupBy("named_entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), ";").alias("ids"))
    lines.select(F.concat_ws(" ::: ", "named_entity", "ids")).write.text(at)
    return tokenizer.read_lexicon_text(spark, at)


@query("SELECT 'What is ' || coalesce(enlabel, '') || '?' AS utterance, 'Quel ' || frlabel || ' ?' AS utterance_fr, row_number() OVER (ORDER BY row_id) * 0 + 1 AS one FROM lexicon_base")
def src_questions(spark, d):
    at = scratch(spark)
    t = table(spark, d, "lexicon_base")
    rows = t.select(F.concat(F.lit("What is "), F.coalesce("enlabel", F.lit("")), F.lit("?")).alias("utterance"), F.concat(F.lit("Quel "), "frlabel", F.lit(" ?")).alias("utterance_fr"), F.concat(F.lit("(list (description "), "id", F.lit("))")).alias("targetValue"))
    sources.write_json_lines(rows, at)
    return tokenizer.read_questions(spark, at).select("utterance", "utterance_fr", F.size(T.answers_description(F.col("targetValue"))).cast("long").alias("one"))


@query("""SELECT 'w' || c_custkey AS surface, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS lo, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 2 END AS hi, 'N' AS postag, 'Q' || c_nationkey AS macro, 'A' || c_custkey AS answer FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'w' || c_custkey, i, i, 'N', CASE i WHEN 1 THEN 'NONE' ELSE 'Q' || c_nationkey END, NULL FROM customer, (SELECT unnest([1, 2]) AS i) WHERE c_custkey % 2 = 1""")
def src_annotated(spark, d):
    """Annotated sentences, with a row 1-2 in place of its parts and answers in every second one."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    row = lambda idx, macro: F.concat(F.lit(f"{idx} w"), key, F.lit(" N "), macro)
    q = F.concat(F.lit("Q"), nation)
    even = F.concat_ws("\n", F.concat(F.lit("0 A"), key), row("1-2", q), row("1", F.lit("NONE")), row("2", F.lit("NONE")))
    odd = F.concat_ws("\n", row("1", F.lit("NONE")), row("2", q))
    at = scratch(spark)
    table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd).alias("v")).write.option("lineSep", "\n\n").text(at)
    tokens, answers = tokenizer.read_annotated(spark, at)
    answers = answers.select(F.col("sent_id").alias("s"), F.get("answers", F.lit(0)).alias("answer"))
    return tokens.join(answers, F.col("sent_id") == F.col("s"), "left").select("surface", "lo", "hi", "postag", "macro", "answer")


@query("SELECT l_returnflag || '|' || l_linestatus AS x, CAST(l_linenumber AS VARCHAR) AS y, round(sum(l_tax), 6) AS w FROM lineitem GROUP BY ALL")
def src_weights(spark, d):
    at = scratch(spark)
    V.save(table(spark, d, "lineitem").groupBy(F.array("l_returnflag", "l_linestatus").alias("x"), F.col("l_linenumber").cast("string").alias("y")).agg(F.sum("l_tax").alias("w")), at)
    return V.load(spark, at).select(F.array_join("x", "|").alias("x"), "y", F.round("w", 6).alias("w"))


@query("SELECT 'P5' AS p, count(*) AS n FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) UNION ALL SELECT 'P2', count(*) FROM (SELECT DISTINCT c_custkey, c_nationkey FROM customer)")
def src_triples(spark, d):
    """Triples written by property; a query on two properties reads two folders."""
    at = scratch(spark)
    sources.write_triples(KnowledgeBase.from_tables(spark, d).triples, at)
    return sources.read_triples(spark, at).filter(F.col("p").isin("P2", "P5")).groupBy("p").agg(F.count("*").alias("n"))


@query("""SELECT row_id, CASE WHEN enlabel = 'et' THEN 'AND' WHEN enlabel = 'ou' THEN 'OR' ELSE coalesce(list_filter(coalesce(bridging, []), lambda x: starts_with(x, 'P'))[1], bridging[1]) END AS macro FROM lexicon_base""")
def text_macro(spark, d):
    """What a label stands for where its row's properties are its candidates: coordination first, then the entity."""
    return table(spark, d, "lexicon_base").select("row_id", T.macro(F.col("enlabel"), F.col("bridging")).alias("macro"))


@query("SELECT row_id, enlabel AS form, enlabel AS longest FROM lexicon_base WHERE enlabel LIKE '% %'")
def text_trie_saved(spark, d):
    """Every label of several words found whole by a trie of all of them that was saved and loaded again in every task."""
    keys = table(spark, d, "lexicon_base").filter(F.col("enlabel").contains(" ")).select("row_id", "enlabel")
    with tempfile.TemporaryDirectory() as folder:  # on the driver, for the length of one write
        at = os.path.join(folder, "trie")
        Trie(r[0] for r in keys.select("enlabel").distinct().toLocalIterator()).save(at)
        with open(at, "rb") as f:
            saved = spark.sparkContext.broadcast(f.read())

    def run(batches):
        with tempfile.TemporaryDirectory() as own:
            path = os.path.join(own, "trie")
            with open(path, "wb") as f:
                f.write(saved.value)
            trie = Trie.load(path)
        for b in batches:
            rows = b.to_pandas()
            rows["longest"] = [t[: trie.longest(t + " et plus", 0)] for t in rows["enlabel"]]
            yield rows

    return keys.mapInArrow(lambda bs: (pa.RecordBatch.from_pandas(x, preserve_index=False) for x in run(bs)), "row_id long, enlabel string, longest string").select("row_id", F.col("enlabel").alias("form"), "longest")


def _forms():
    key = F.col("p_partkey").cast("string")
    texts = [("(JOIN wdt:P2 wd:Q", ")"), ("(and (wdt:P2 wd:Q1 wd:Q", ")"), ('(+ 1 "', '")'), ("(lambda (x:num) (+ x ", "))"), ("(+ (* 2 3) ", ")")]
    out = F.lit(None).cast("string")
    for i, (a, b) in enumerate(texts):
        out = F.when(F.col("p_size") % 5 == i, F.concat(F.lit(a), key, F.lit(b))).otherwise(out)
    return out


@F.pandas_udf(StructType([StructField("status", StringType()), StructField("type", StringType()), StructField("shown", StringType()), StructField("closed", BooleanType())]))
def _read_term(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        try:
            term = parse(t)
            kind = typecheck(term)
            out.append(("ok", show_type(kind), show(normalise(term)), is_closed(term)))
        except TermSyntaxError:
            out.append(("syntax", None, None, None))
        except TypeFailure:
            out.append(("type", None, None, None))
    return pd.DataFrame(out, columns=["status", "type", "shown", "closed"])


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 'syntax' WHEN 2 THEN 'type' ELSE 'ok' END AS status, CASE p_size % 5 WHEN 0 THEN 'e=>t' WHEN 3 THEN 'num=>num' WHEN 4 THEN 'num' END AS type,
  CASE p_size % 5 WHEN 0 THEN '(lambda (x:e) (exists (y:e) (and (wdt:P2 x y) (wd:Q' || p_partkey || ' y))))' WHEN 3 THEN '(lambda (x:num) (+ x ' || p_partkey || '.0))' WHEN 4 THEN '(+ (* 2.0 3.0) ' || p_partkey || '.0)' END AS shown, CASE WHEN p_size % 5 IN (0, 3, 4) THEN true END AS closed FROM part""")
def lang_terms(spark, d):
    """Programs read, checked, normalised and shown; what can't be read or has no type is told apart."""
    return table(spark, d, "part").select("p_partkey", _read_term(_forms()).alias("x")).select("p_partkey", "x.*")


@F.pandas_udf(StringType())
def _with_hooks(texts: pd.Series) -> pd.Series:
    context = standard_context()
    context.function("twice", arrow(NUM, NUM), lambda x: x * 2)
    context.source(["(define more (lambda (x:num) (+ (twice x) 1)))  # a macro over an external function", "(define more (lambda (x:num) (+ (twice x) 5)))"])
    return texts.map(lambda t: show(evaluate(normalise(parse(t, context)))))


@query("SELECT p_partkey, CAST(p_size * 2 + 5 AS VARCHAR) AS shown FROM part")
def lang_hooks(spark, d):
    """A definition file with a macro defined twice, over an external function, evaluated on constants."""
    shown = _with_hooks(F.concat(F.lit("(more "), F.col("p_size").cast("string"), F.lit(")")))
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(shown, r"\.0$", "").alias("shown"))


@query(_PAGERANK + f"""
, e AS (SELECT count(*) AS n FROM ({_ENTITIES})), b AS (SELECT id FROM ({_BASE}))
SELECT 'items' AS step, count(*) AS n FROM item UNION ALL SELECT 'entities', n FROM e UNION ALL SELECT 'paths', count(*) FROM path UNION ALL SELECT 'index', count(*) FROM ids UNION ALL SELECT 'edges', count(*) FROM edge
UNION ALL SELECT 'scores', count(*) FROM ids UNION ALL SELECT 'ranks', count(*) FROM ids UNION ALL SELECT 'lexicon_base', count(*) FROM b""")
def etl_pipeline(spark, d):
    """The whole way from dump to dictionary, and the rows that each step wrote."""
    at = scratch(spark)
    took = pipeline.run(table(spark, d, "dump_lines"), at)
    counts = [spark.read.parquet(f"{at}/{k}").agg(F.count("*").alias("n")).select(F.lit(k).alias("step"), "n") for k in took if k != "dictionary"]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
