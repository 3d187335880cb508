"""Queries of text, lexicon and graph building."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.etl import dump, lexicon, pipeline
from graphloom.graph import rank
from graphloom.plans.data import _DUMP
from graphloom.session import table
from graphloom.text import functions as T
from graphloom.text import tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_NORM = r"""regexp_replace(replace(replace(regexp_replace(replace(regexp_replace(translate({}, '“”»«`‘’', '\"\"\"\"\"'''''), '([?!{{;,}}.:/=+()\[\]\"''\-…])', ' \1 ', 'g'), '…', '...'), '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+', ' ', 'g'), ' ''', ''''), 'œ', 'oe'), '^ ', '')""".replace('\\"', '"')
_DOC_NORM = _NORM.format("text")


@query(f"SELECT doc_id, {_DOC_NORM} AS norm FROM documents")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query(f"SELECT form, count(*) AS n FROM (SELECT unnest(string_split({_DOC_NORM}, ' ')) AS form FROM documents) WHERE form <> '' GROUP BY form")
def text_tokens(spark, d):
    return table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, len(list_filter(string_split({_DOC_NORM}, ' '), lambda x: x <> '')) AS n_words FROM documents WHERE text IS NOT NULL")
def text_token_count(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


_LABELS = "SELECT DISTINCT enlabel AS k FROM lexicon_base WHERE enlabel <> ''"


@query(f"SELECT s.row_id, arg_max(k, length(k)) AS named_entity FROM entity_stats s JOIN ({_LABELS}) l ON starts_with(s.qlabels, k) GROUP BY s.row_id")
def text_longest_prefix(spark, d):
    keys = table(spark, d, "lexicon_base").filter("enlabel <> ''").select(F.col("enlabel").alias("named_entity"))
    return tokenizer.longest_prefix(table(spark, d, "entity_stats"), "row_id", "qlabels", keys)


def _lexicon(spark, d):
    rows = table(spark, d, "lexicon_base").select("id", F.col("rank_order").alias("rank"), F.explode(F.array("enlabel", "frlabel")).alias("named_entity"))
    return rows.filter("named_entity IS NOT NULL")


@query("""SELECT named_entity, id AS linked FROM (
  SELECT named_entity, id, row_number() OVER (PARTITION BY named_entity ORDER BY CASE WHEN id LIKE 'P%' THEN 0 ELSE 1 END, rank_order, id) AS r
  FROM (SELECT unnest([enlabel, frlabel]) AS named_entity, id, rank_order FROM lexicon_base) WHERE named_entity IS NOT NULL) WHERE r = 1""")
def text_link_entity(spark, d):
    """What every label is linked to, as a token of its own."""
    lex = _lexicon(spark, d)
    forms = lex.select(F.col("named_entity").alias("form"), F.lit("key").alias("kind")).distinct()
    return tokenizer.link(forms, lex).select(F.col("form").alias("named_entity"), F.col("macro").alias("linked"))


@query()
def text_linked_tokens(spark, d):
    """Tokens of all documents with what they stand for, and the document's source."""
    lex = _lexicon(spark, d)
    docs = table(spark, d, "documents")
    toks = tokenizer.tokenize(docs, "doc_id", "text", lex, compounds=tokenizer.compound_regex(), keep=("source",))
    return tokenizer.link(toks, lex).select("doc_id", "pos", "form", "kind", "macro", "source")


@query(f"""SELECT macro, count(*) AS n FROM (SELECT CASE WHEN form = 'et' THEN 'AND' WHEN form = 'ou' THEN 'OR' WHEN form IN ({", ".join(f"'{w}'" for w in T.WH_WORDS)}) THEN 'WHQ' END AS macro
  FROM (SELECT unnest(string_split({_DOC_NORM}, ' ')) AS form FROM documents)) WHERE macro IS NOT NULL GROUP BY macro""")
def text_function_words(spark, d):
    forms = table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("form"))
    return forms.select(T.function_word(F.col("form")).alias("macro")).filter("macro IS NOT NULL").groupBy("macro").agg(F.count("*").alias("n"))


_TARGET = "'(list (description \"' || coalesce(enlabel, '') || '\") (description ' || id || '))'"


@query(f"""SELECT row_id, pos - 1 AS pos, regexp_replace(trim(x, ' '), '^"|"$', '', 'g') AS answer FROM (
  SELECT row_id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM (SELECT row_id, regexp_extract_all({_TARGET}, '\\(description ([^()]*)\\)', 1) AS l FROM lexicon_base))""")
def text_answers_description(spark, d):
    target = F.concat(F.lit('(list (description "'), F.coalesce("enlabel", F.lit("")), F.lit('") (description '), F.col("id"), F.lit("))"))
    return table(spark, d, "lexicon_base").select("row_id", F.posexplode(T.answers_description(target)).alias("pos", "answer"))


@query("SELECT path_id, unnest(string_split(array_to_string(path_ids, ','), ',')) AS answer FROM statement_paths")
def text_answers_comma(spark, d):
    return table(spark, d, "statement_paths").select("path_id", F.explode(T.answers_comma(F.array_join("path_ids", ","))).alias("answer"))


@query("SELECT path_id, 'http://kg/entity/' || item_id AS iri, string_split('http://kg/entity/' || item_id, '/')[-1] AS tail FROM statement_paths")
def text_iri_tail(spark, d):
    rows = table(spark, d, "statement_paths").select("path_id", F.concat(F.lit("http://kg/entity/"), "item_id").alias("iri"))
    return rows.withColumn("tail", T.iri_tail(F.col("iri")))


@query("""SELECT row_id FROM entity_stats WHERE nlanguages >= 1 AND nclaims >= 1 AND (coalesce(is_instance, false) OR coalesce(is_subclass, false))
  AND ((ent_idx LIKE 'Q%' AND nsitelinks >= 1) OR ent_idx LIKE 'P%')""")
def etl_relevance(spark, d):
    return table(spark, d, "entity_stats").filter(dump.relevant("ent_idx")).select("row_id")


@query("SELECT row_id, label FROM (SELECT DISTINCT row_id, unnest([enlabel, frlabel] || coalesce(fraliase, [])) AS label FROM lexicon_base) WHERE label IS NOT NULL")
def etl_label_bundle(spark, d):
    return table(spark, d, "lexicon_base").select("row_id", F.explode(dump.label_bundle(F.col("enlabel"), F.col("frlabel"), aliases=F.col("fraliase"))).alias("label"))


# the dump in SQL: items with an id, their labels and paths; `element` and `ok` come from the lines' own SQL
_VALUE = "CASE json_type({0}) WHEN 'OBJECT' THEN CASE WHEN json_type({0}, '$.value') = 'VARCHAR' THEN json_extract_string({0}, '$.value') END WHEN 'VARCHAR' THEN json_extract_string({0}, '$') END"
_SIZE = "CASE WHEN json_type(j, '$.{0}') = 'OBJECT' THEN len(json_keys(j, '$.{0}')) ELSE 0 END::BIGINT"
_ITEMS = _DUMP.replace("WITH dump", "WITH RECURSIVE dump", 1) + f""",
item0 AS (SELECT line_no, json_extract_string(j, '$.id') AS id, {_SIZE.format("claims")} AS nclaims, {_SIZE.format("labels")} AS nlanguages, {_SIZE.format("sitelinks")} AS nsitelinks,
  json_extract(j, '$.labels.en') AS en0, json_extract(j, '$.labels.fr') AS fr0, json_extract(j, '$.aliases.fr') AS al0, CASE WHEN json_type(j, '$.claims') = 'OBJECT' THEN json_keys(j, '$.claims') ELSE [] END AS props
  FROM ok WHERE json_type(j, '$.id') = 'VARCHAR'),
item AS (SELECT * EXCLUDE (en0, fr0, al0), list_contains(props, 'P31') AS is_instance, list_contains(props, 'P279') AS is_subclass, {_VALUE.format("en0")} AS en, {_VALUE.format("fr0")} AS local,
  list_filter(list_transform(CASE json_type(al0) WHEN 'ARRAY' THEN al0::JSON[] WHEN 'NULL' THEN [] ELSE [al0] END, lambda a: {_VALUE.format("a")}), lambda a: a IS NOT NULL) AS aliases FROM item0),
kept AS (SELECT * FROM item WHERE nlanguages >= 1 AND nclaims >= 1 AND (is_instance OR is_subclass) AND (id LIKE 'Q%' AND nsitelinks >= 1 OR id LIKE 'P%') AND en IS NOT NULL),
st AS (SELECT e.line_no, k.id, entry_key AS p, v, CASE WHEN json_type(v, '$.mainsnak.datavalue.value.id') = 'VARCHAR' THEN json_extract_string(v, '$.mainsnak.datavalue.value.id') END AS o
  FROM element e JOIN kept k USING (line_no) WHERE sect = 'claims' AND json_type(v) = 'OBJECT'),
qa AS (SELECT line_no, id, p, o, v, unnest(CASE WHEN json_type(v, '$.qualifiers') = 'OBJECT' THEN json_keys(v, '$.qualifiers') ELSE [] END) AS q FROM st),
qb AS (SELECT *, json_extract(v, '$.qualifiers."' || q || '"') AS qv FROM qa),
qc AS (SELECT *, CASE json_type(qv) WHEN 'ARRAY' THEN json_extract(qv, '$[0]') ELSE qv END AS first FROM qb),
qd AS (SELECT *, CASE WHEN json_type(first, '$.datavalue.value.id') = 'VARCHAR' THEN json_extract_string(first, '$.datavalue.value.id') END AS o2 FROM qc WHERE coalesce(json_type(first, '$.datavalue.value'), 'NULL') <> 'NULL'),
path AS (SELECT line_no, id AS item_id, [id, p, o] AS path_ids FROM st WHERE o IS NOT NULL AND (coalesce(json_type(v, '$.qualifiers'), '') <> 'OBJECT' OR len(json_keys(v, '$.qualifiers')) = 0)
  UNION ALL SELECT line_no, id, CASE WHEN o2 IS NULL THEN [id, p, o] ELSE [id, p, o, q, o2] END FROM qd WHERE o IS NOT NULL
  UNION ALL SELECT line_no, id, [id, p, q, o2] FROM qd WHERE o IS NULL AND o2 IS NOT NULL)
"""
_ENTITIES = """SELECT id AS ent_idx, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ';') AS qlabels, nclaims, nlanguages, nsitelinks, is_instance, is_subclass, 0.0::DOUBLE AS neg_page_rank
  FROM (SELECT *, list_filter([en, local] || aliases, lambda x: x IS NOT NULL) AS l FROM kept)"""


@query(_ITEMS + _ENTITIES)
def etl_entity_rows(spark, d):
    """The entity table made from the dump."""
    return dump.entity_rows(dump.read_items(table(spark, d, "dump_lines")))


@query(_ITEMS + "SELECT item_id, array_to_string(path_ids, ' ') AS path FROM path")
def etl_statement_paths(spark, d):
    return dump.paths(dump.read_items(table(spark, d, "dump_lines"))).select("item_id", F.array_join("path_ids", " ").alias("path"))


_CLASSES = "SELECT id FROM core_entities WHERE kind = 'item'"


@query(_ITEMS + f"""SELECT id, unnest(list_distinct(list_filter([coalesce(local, en)] || aliases, lambda x: x IS NOT NULL))) AS name FROM item WHERE line_no IN (
  SELECT line_no FROM element WHERE sect = 'claims' AND entry_key = 'P31' AND json_type(v, '$.mainsnak.datavalue.value.id') = 'VARCHAR' AND json_extract_string(v, '$.mainsnak.datavalue.value.id') IN ({_CLASSES}))""")
def etl_humans(spark, d):
    """Names of the instances of the core items, which stand for the human classes that these tables lack."""
    classes = [r["id"] for r in table(spark, d, "core_entities").filter("kind = 'item'").select("id").collect()]  # 40 at every scale
    return dump.humans(dump.read_items(table(spark, d, "dump_lines")), classes).select("id", F.explode("names").alias("name"))


_PLURAL = "CASE WHEN w LIKE '%y' THEN w[:-2] || 'ies' WHEN w LIKE '%s' OR w LIKE '%x' OR w LIKE '%sh' OR w LIKE '%ch' THEN w || 'es' WHEN w LIKE '%an' THEN w[:-3] || 'en' ELSE w || 's' END"


@query(f"SELECT DISTINCT w AS word, {_PLURAL} AS plural FROM (SELECT unnest(string_split(enlabel, ' ')) AS w FROM lexicon_base) WHERE w <> ''")
def etl_plural(spark, d):
    words = table(spark, d, "lexicon_base").select(F.explode(F.split("enlabel", " ")).alias("word")).filter("word <> ''").distinct()
    return words.select("word", T.plural(F.col("word")).alias("plural"))


_TITLE = "array_to_string(list_transform(regexp_extract_all(label, '[\\p{Lu}\\p{Ll}\\p{Lt}\\x{2160}-\\x{217F}\\x{24B6}-\\x{24E9}]+|[^\\p{Lu}\\p{Ll}\\p{Lt}\\x{2160}-\\x{217F}\\x{24B6}-\\x{24E9}]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
_LABEL_PLURAL = f"CASE WHEN label = enlabel AND label NOT LIKE '% %' AND label <> '' THEN {_PLURAL.replace('w LIKE', 'label LIKE').replace('w[', 'label[').replace('w ||', 'label ||')} END"
_LABEL_ROWS = "SELECT DISTINCT row_id, label, enlabel, id, rank_order FROM (SELECT row_id, enlabel, id, rank_order, unnest([enlabel, frlabel] || coalesce(fraliase, [])) AS label FROM base) WHERE label IS NOT NULL"


@query(f"""WITH base AS (SELECT * FROM lexicon_base), labels AS ({_LABEL_ROWS})
SELECT row_id, unnest(list_distinct(list_filter([label, lower(label), upper(label[1]) || lower(label[2:]), {_TITLE}, {_LABEL_PLURAL}], lambda x: x IS NOT NULL))) AS variant FROM labels""")
def etl_variants(spark, d):
    return lexicon.variants(table(spark, d, "lexicon_base")).select("row_id", "variant")


@query(f"""WITH base AS (SELECT * FROM lexicon_base WHERE id NOT IN ({", ".join(f"'{i}'" for i in (*T.STOP_IDS, *T.WH_IDS))})),
labels AS (SELECT DISTINCT row_id, label, enlabel, id, rank_order FROM (SELECT row_id, enlabel, id, rank_order, unnest([enlabel, frlabel] || coalesce(fraliase, [])) AS label FROM base) WHERE label IS NOT NULL),
v AS (SELECT unnest([label, lower(label), upper(label[1]) || lower(label[2:]), CASE WHEN label = enlabel AND label NOT LIKE '% %' AND label <> '' THEN {_PLURAL.replace("w", "label").replace("labelhen", "when").replace("WHEN", "WHEN")} END]) AS named_entity, id, rank_order FROM labels),
k AS (SELECT named_entity, id, min(rank_order) AS o FROM v WHERE regexp_matches(named_entity, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(named_entity, '[*+()\\[\\]?\\\\]') GROUP BY ALL)
SELECT named_entity, row_number() OVER (PARTITION BY named_entity ORDER BY o, id) - 1 AS pos, id FROM k""")
def etl_inverted_dictionary(spark, d):
    """The dictionary without title case, which SQL lacks; etl_inverted_dictionary_full is the whole one."""
    return lexicon.dictionary(table(spark, d, "lexicon_base"), "rank_order", title_case=False)


@query(f"""WITH base AS (SELECT * FROM lexicon_base WHERE id NOT IN ({", ".join(f"'{i}'" for i in (*T.STOP_IDS, *T.WH_IDS))})), labels AS ({_LABEL_ROWS}),
v AS (SELECT unnest([label, lower(label), upper(label[1]) || lower(label[2:]), {_TITLE}, {_LABEL_PLURAL}]) AS named_entity, id, rank_order FROM labels),
k AS (SELECT named_entity, id, min(rank_order) AS o FROM v WHERE regexp_matches(named_entity, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(named_entity, '[*+()\\[\\]?\\\\]') GROUP BY ALL)
SELECT named_entity, row_number() OVER (PARTITION BY named_entity ORDER BY o, id) - 1 AS pos, id FROM k""")
def etl_inverted_dictionary_full(spark, d):
    """The dictionary with all four case forms of every label."""
    return lexicon.dictionary(table(spark, d, "lexicon_base"), "rank_order")


_CHAIN = "SELECT path_ids[i] AS src, path_ids[i + 1] AS dst FROM statement_paths, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE i < len(path_ids)"
# rounds go on to the hundredth; the scores are those of the first tenth round that moved less than the tolerance
_ROUNDS = """
ids AS (SELECT src AS id FROM edge UNION SELECT dst FROM edge), deg AS (SELECT src, count(*) AS n FROM edge GROUP BY src), c AS (SELECT count(*) AS n FROM ids),
pr AS (SELECT 0 AS k, id, 1.0::DOUBLE / c.n AS score FROM ids, c UNION ALL (
  WITH now AS (SELECT * FROM pr), got AS (SELECT edge.dst AS id, sum(now.score / deg.n) AS got FROM edge JOIN now ON now.id = edge.src JOIN deg ON deg.src = edge.src GROUP BY edge.dst),
  lost AS (SELECT coalesce(sum(score), 0) AS x FROM now WHERE id NOT IN (SELECT src FROM deg))
  SELECT now.k + 1, now.id, 0.15::DOUBLE / c.n + 0.85::DOUBLE * lost.x / c.n + 0.85::DOUBLE * coalesce(got, 0) FROM now CROSS JOIN c CROSS JOIN lost LEFT JOIN got ON got.id = now.id WHERE now.k < 100)),
last AS (SELECT min(k) AS k FROM (SELECT a.k, sum(abs(a.score - b.score)) AS moved FROM pr a JOIN pr b ON b.id = a.id AND b.k = a.k - 1 WHERE a.k % 10 = 0 GROUP BY a.k) WHERE moved < 1e-5),
score AS (SELECT id, score FROM pr JOIN last USING (k))
"""
_PAGERANK = _ITEMS + f", edge AS (SELECT DISTINCT * FROM ({_CHAIN.replace('statement_paths', 'path')}) WHERE src IS NOT NULL AND dst IS NOT NULL)," + _ROUNDS
_BASE = """SELECT b.id, b.en AS enlabel, r.o AS "order", b.local AS frlabel, array_to_string(b.aliases, '|') AS fraliase, pr_.bridging
  FROM item b JOIN (SELECT id, row_number() OVER (ORDER BY round(score * c.n / 1e-9) DESC, id) - 1 AS o FROM score, c) r ON r.id = b.id
  LEFT JOIN (SELECT id, array_to_string(list(p ORDER BY o, p), '|') AS bridging, count(*) = count(o) AS every FROM (
    SELECT x.id, x.p, y.o FROM (SELECT i.id, unnest(i.props) AS p FROM item i JOIN score s ON s.id = i.id WHERE i.en IS NOT NULL AND i.id LIKE 'Q%') x
    LEFT JOIN (SELECT id, row_number() OVER (ORDER BY round(score * c.n / 1e-9) DESC, id) - 1 AS o FROM score, c) y ON y.id = x.p) GROUP BY id) pr_ ON pr_.id = b.id
  WHERE b.en IS NOT NULL AND coalesce(pr_.every, true)"""


@query(_PAGERANK + _BASE)
def etl_lexicon_base(spark, d):
    """The lexicon base from the dump and the converged ranks of its own paths."""
    items = dump.read_items(table(spark, d, "dump_lines"))
    ranks = pipeline.stable_ranks(rank.pagerank(rank.edges(dump.paths(items))))
    base = lexicon.lexicon_base(items, ranks)
    return base.select("id", "enlabel", "order", "frlabel", F.array_join("fraliase", "|").alias("fraliase"), F.array_join("bridging", "|").alias("bridging"))


@query("""SELECT id, rn - 1 AS pos, property FROM (SELECT l.row_id AS id, b.property, row_number() OVER (PARTITION BY l.row_id ORDER BY r.best DESC, b.property) AS rn
  FROM lexicon_base l, (SELECT DISTINCT row_id, unnest(bridging) AS property FROM lexicon_base) b, (SELECT id, max(score) AS best FROM rank_scores GROUP BY id) r WHERE b.row_id = l.row_id AND r.id = b.property)""")
def etl_bridging(spark, d):
    """A row's distinct ranked properties, best first."""
    scores = table(spark, d, "rank_scores").groupBy("id").agg(F.max("score").alias("best")).withColumnRenamed("id", "property")
    rows = table(spark, d, "lexicon_base").select(F.col("row_id").alias("id"), F.explode(F.array_distinct("bridging")).alias("property")).join(scores, "property")
    ordered = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("o"), "property"))).alias("x"))
    return ordered.select("id", F.posexplode("x").alias("pos", "x")).select("id", "pos", "x.property")


_SHORT = "SELECT path_ids[1], path_ids[3] FROM statement_paths WHERE len(path_ids) = 3 UNION SELECT path_ids[1], path_ids[4] FROM statement_paths WHERE len(path_ids) = 4 UNION SELECT path_ids[a], path_ids[b] FROM statement_paths, (SELECT unnest([1, 1, 3]) AS a, unnest([3, 5, 5]) AS b) WHERE len(path_ids) = 5"


@query(f"SELECT DISTINCT * FROM ({_CHAIN}) WHERE src IS NOT NULL AND dst IS NOT NULL")
def etl_edges_chain(spark, d):
    return rank.edges(table(spark, d, "statement_paths"), 1)


@query(f"SELECT DISTINCT * FROM ({_CHAIN} UNION {_SHORT}) WHERE src IS NOT NULL AND dst IS NOT NULL")
def etl_edges_shortcut(spark, d):
    return rank.edges(table(spark, d, "statement_paths"), 2)


@query("SELECT id, row_number() OVER (ORDER BY id) - 1 AS node FROM (SELECT DISTINCT unnest(path_ids) AS id FROM statement_paths) WHERE id IS NOT NULL")
def etl_node_index(spark, d):
    return rank.node_index(table(spark, d, "statement_paths"))


def _pagerank_sql(rounds: int) -> str:
    out = f"""WITH e AS (SELECT DISTINCT * FROM ({_CHAIN}) WHERE src IS NOT NULL AND dst IS NOT NULL),
ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e), deg AS (SELECT src, count(*) AS n FROM e GROUP BY src), c AS (SELECT count(*) AS n FROM ids),
r0 AS (SELECT id, 1.0::DOUBLE / c.n AS score FROM ids, c)"""
    for k in range(rounds):
        out += f""",
g{k} AS (SELECT e.dst AS id, sum(r.score / deg.n) AS got FROM e JOIN r{k} r ON r.id = e.src JOIN deg ON deg.src = e.src GROUP BY e.dst),
l{k} AS (SELECT coalesce(sum(score), 0) AS x FROM r{k} WHERE id NOT IN (SELECT src FROM deg)),
r{k + 1} AS (SELECT ids.id, 0.15::DOUBLE / c.n + 0.85::DOUBLE * l{k}.x / c.n + 0.85::DOUBLE * coalesce(got, 0) AS score FROM ids CROSS JOIN c CROSS JOIN l{k} LEFT JOIN g{k} ON g{k}.id = ids.id)"""
    return out + f" SELECT id, round(score, 9) AS score FROM r{rounds}"


@query(_pagerank_sql(5))
def graph_pagerank(spark, d):
    """The scores after five rounds, which SQL can follow; graph_pagerank_converged has the scores to use."""
    return rank.pagerank(rank.edges(table(spark, d, "statement_paths")), rounds=5).select("id", F.round("score", 9).alias("score"))


@query(f"WITH RECURSIVE edge AS (SELECT DISTINCT * FROM ({_CHAIN}) WHERE src IS NOT NULL AND dst IS NOT NULL)," + _ROUNDS + "SELECT id, round(score, 9) AS score FROM score")
def graph_pagerank_converged(spark, d):
    """The scores at the operator's tolerance."""
    return rank.pagerank(rank.edges(table(spark, d, "statement_paths"))).select("id", F.round("score", 9).alias("score"))


@query("""SELECT row_id, id, edge_mode, row_number() OVER (ORDER BY score DESC, row_id) - 1 AS "order" FROM rank_scores WHERE id IS NOT NULL AND score IS NOT NULL""")
def graph_rank_order(spark, d):
    scores = table(spark, d, "rank_scores").filter("id IS NOT NULL AND score IS NOT NULL").select("row_id", "id", "edge_mode", "score")
    return rank.ranked(scores, ["row_id"]).select("row_id", "id", "edge_mode", "order")


@query("SELECT id, enlabel, rank_order FROM lexicon_base ORDER BY rank_order, row_id LIMIT 500")
def graph_topn(spark, d):
    return lexicon.top(table(spark, d, "lexicon_base"), 500, "rank_order", ("row_id",)).select("id", "enlabel", "rank_order")
