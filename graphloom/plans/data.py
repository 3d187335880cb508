"""Queries over the dump, the loaders' rows, the lexicon and the id log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import bare_id
from graphloom.operators import hierarchy, nested, packed, references
from graphloom.operators.skew import small_enough
from graphloom.session import cut, table

DUMP_PATHS = ("labels.*", "sitelinks.*", "aliases.*[]", "claims.*[]", "claims.*[].qualifiers.*[]")
#: Steps from a claim to its qualifiers: the field's name, the property and the place.
QUALIFIER_STEPS = 3
#: core_entities is broadcast up to so many rows and joined by shuffle beyond.
BROADCAST_ROWS = 100_000


def dump_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.shred(table(spark, d, "dump_lines"), "line_no", "line", DUMP_PATHS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Flat rows of the dump: every label, sitelink, alias, claim and qualifier with its line, entry and places.

    Places are read off the labels: an element's is the last ordinal of its own, a qualifier's claim is its label cut short.
    """
    nodes = dump_nodes(spark, d)
    qualifier, one = F.col("node_path") == DUMP_PATHS[-1], ~F.col("node_path").endswith("[]")
    sect = F.when(qualifier, "qualifiers").otherwise(F.substring_index("node_path", ".", 1))
    element = F.when(qualifier, nested.parent_label(F.col("dewey"), QUALIFIER_STEPS, 2 * QUALIFIER_STEPS)).otherwise(F.col("dewey"))
    return nodes.select(
        "line_no", sect.alias("sect"), F.get("keys", F.lit(0)).alias("entry_key"), F.when(one, 0).otherwise(nested.ordinal(element)).alias("pos"),
        F.when(qualifier, F.get("keys", F.lit(1))).otherwise("").alias("sub_key"), F.when(qualifier, nested.ordinal(F.col("dewey"))).otherwise(-1).alias("sub_pos"))


def p2_claims(spark: SparkSession, d: str) -> DataFrame:
    """Every claim with the number of its qualifiers: the tables of the two schema paths joined by the parent's label."""
    tables = nested.node_tables(cut(dump_nodes(spark, d).filter(F.col("node_path").startswith("claims"))), DUMP_PATHS[-2:])
    claims, quals = (tables[p] for p in DUMP_PATHS[-2:])
    per = quals.groupBy(F.col("line_no").alias("l"), nested.parent_label(F.col("dewey"), QUALIFIER_STEPS, 2 * QUALIFIER_STEPS).alias("p")).agg(F.count("*").alias("n"))
    both = claims.join(per, (F.col("line_no") == F.col("l")) & (F.col("dewey") == F.col("p")), "left")
    return both.select("line_no", F.get("keys", F.lit(0)).alias("entry_key"), nested.ordinal(F.col("dewey")).alias("pos"), F.coalesce("n", F.lit(0)).alias("n_qualifiers"))


def references_at(spark: SparkSession, d: str) -> DataFrame:
    """(src_table, row_id, ref_id, at): each row's distinct references as bare ids, with the time they were made."""
    lex = table(spark, d, "lexicon_base").select(F.lit("lexicon_base").alias("src_table"), "row_id", F.explode(F.array_distinct(F.concat(F.array(bare_id("id")), F.coalesce(F.transform("bridging", bare_id), F.array().cast("array<string>"))))).alias("ref_id"), F.col("built_at").alias("at"))
    rank = table(spark, d, "rank_scores").select(F.lit("rank_scores").alias("src_table"), "row_id", bare_id("id").alias("ref_id"), F.col("computed_at").alias("at"))
    stats = table(spark, d, "entity_stats").select(F.lit("entity_stats").alias("src_table"), "row_id", bare_id("ent_idx").alias("ref_id"), F.col("loaded_at").alias("at"))
    return lex.unionByName(rank).unionByName(stats)


def orphan_references(spark: SparkSession, d: str) -> DataFrame:
    core = table(spark, d, "core_entities").select(bare_id("id").alias("ref_id"), F.col("created_at").alias("since"), F.col("deleted_at").alias("until"))
    log = table(spark, d, "id_log").withColumn("id", bare_id("id"))
    lives = cut(references.lifetimes(log, "id", "act", "logged_at", "log_id").withColumnRenamed("id", "ref_id"))
    # the fixed table goes first: it takes out the ids that most rows refer to, before anything is shuffled
    rest = cut(references.orphans(references_at(spark, d), core, ["ref_id"], "simple", "at", "since", "until", small=small_enough(core, BROADCAST_ROWS)))
    return references.orphans(rest, lives, ["ref_id"], "simple", "at", "since", "until")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References to ids that weren't alive when they were made."""
    return orphan_references(spark, d).select("src_table", "row_id", "ref_id")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted per table and month of the reference."""
    month = F.date_format("at", "yyyy-MM").alias("ref_month")
    return orphan_references(spark, d).groupBy("src_table", month).agg(F.count("*").alias("n_orphans"), F.countDistinct("row_id").alias("n_rows"))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose item has no label in the document's language, under each match of the composite key (item_id, lang)."""
    docs = table(spark, d, "documents").select("doc_id", bare_id("item_id").alias("item_id"), F.lower("lang").alias("lang"))
    lex = table(spark, d, "lexicon_base")
    labels = lex.filter("enlabel IS NOT NULL").select(bare_id("id").alias("item_id"), F.lit("en").alias("lang")).unionByName(lex.filter("frlabel IS NOT NULL").select(bare_id("id").alias("item_id"), F.lit("fr").alias("lang")))
    keys = labels.distinct()
    out = None
    for match in references.MATCHES:
        found = references.orphans(docs, keys, ["item_id", "lang"], match).select("doc_id", F.lit(match).alias("match_kind"))
        out = found if out is None else out.unionByName(found)
    return out


def class_links(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent) of the P279 claims whose main value is an object with an id, as bare ids."""
    # only a line that holds the key, written plainly or with escapes, can have such a claim
    lines = table(spark, d, "dump_lines").filter(F.col("line").contains("P279") | F.col("line").contains("\\u"))
    claims = nested.shred(lines, "line_no", "line", ["claims.P279[].mainsnak.datavalue.value.id"], ["id"], values=True)
    return claims.select(bare_id("id").alias("child"), bare_id("node_value").alias("parent")).filter("child IS NOT NULL AND parent IS NOT NULL")


def class_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    links = cut(hierarchy.tree_links(class_links(spark, d), "child", "parent"))
    return links, hierarchy.nested_sets(links)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every class; circles are marked by depth -1, what hangs below one by -2."""
    return class_tree(spark, d)[1].select("id", "root_id", "tree_depth")


def p6_tree(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root and number of descendants of every class, and what entity_stats says of it."""
    links, sets = class_tree(spark, d)
    sets = cut(sets)
    flags = table(spark, d, "entity_stats").groupBy(bare_id("ent_idx").alias("__e")).agg(F.bool_or("is_subclass").alias("flagged"))
    out = sets.join(hierarchy.paths(links, sets).withColumnRenamed("id", "__p"), F.col("id") == F.col("__p"))
    return out.join(flags, F.col("id") == F.col("__e"), "left").select("id", "root_id", "tree_depth", "tree_path", "n_descendants", "flagged")


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every class with each of its descendants, by ranges of the preorder; read the other way, every class with its ancestors."""
    sets = cut(class_tree(spark, d)[1])
    return hierarchy.descendants(sets, sets)


def p6_other_parents(spark: SparkSession, d: str) -> DataFrame:
    """Links to further parents, which no tree of one parent a node holds."""
    return hierarchy.other_parents(class_links(spark, d), "child", "parent")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The labels packed in qlabels, one row a label, in stored order."""
    return packed.split_packed(table(spark, d, "entity_stats"), "row_id", "qlabels").select("row_id", "pos", "label_value")


QUERIES = {f.__name__: f for f in (p2_found, p2_claims, p5_found, p5_report, p5_labels, p6_found, p6_tree, p6_descendants, p6_other_parents, p7_found)}

_BARE = "nullif(upper(regexp_replace(regexp_replace({}, '^(?s:.*)[:/]', ''), '\\s+', '', 'g')), '')"
_REFS = f"""
WITH refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'lexicon_base' AS src_table, row_id, {_BARE.format('id')} AS ref_id, built_at AS ref_at FROM lexicon_base
    UNION ALL SELECT 'lexicon_base', row_id, {_BARE.format('b')}, built_at FROM (SELECT row_id, unnest(bridging) AS b, built_at FROM lexicon_base)
    UNION ALL SELECT 'rank_scores', row_id, {_BARE.format('id')}, computed_at FROM rank_scores
    UNION ALL SELECT 'entity_stats', row_id, {_BARE.format('ent_idx')}, loaded_at FROM entity_stats)
  WHERE ref_id IS NOT NULL),
lives AS (
  SELECT {_BARE.format('id')} AS id, created_at AS since, deleted_at AS until FROM core_entities
  UNION ALL SELECT id, since, until FROM (
    SELECT {_BARE.format('id')} AS id, logged_at AS since, act,
           lead(logged_at) OVER (PARTITION BY {_BARE.format('id')} ORDER BY logged_at, log_id) AS until FROM id_log) WHERE act <> 'delete'),
missing AS (
  SELECT * FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM lives l WHERE l.id = r.ref_id AND l.since <= r.ref_at AND (l.until IS NULL OR r.ref_at < l.until)))
"""
ORACLE = {
    "p5_found": _REFS + "SELECT src_table, row_id, ref_id FROM missing",
    "p5_report": _REFS + "SELECT src_table, strftime(ref_at, '%Y-%m') AS ref_month, count(*) AS n_orphans, count(DISTINCT row_id) AS n_rows FROM missing GROUP BY ALL",
}

_DUMP = r"""
WITH dump AS (SELECT line_no, regexp_replace(regexp_replace(line, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g'), ',$', '') AS t FROM dump_lines),
ok AS (SELECT line_no, t::JSON AS j FROM dump WHERE t LIKE '{%' AND json_valid(t)),
flat AS (
  SELECT line_no, s AS sect, unnest(json_keys(j, '$.' || s)) AS entry_key, j FROM ok, (SELECT unnest(['labels', 'sitelinks', 'aliases', 'claims']) AS s) WHERE json_type(j, '$.' || s) = 'OBJECT'),
entry AS (SELECT line_no, sect, entry_key, json_extract(j, '$.' || sect || '."' || entry_key || '"') AS v FROM flat),
element AS (
  SELECT line_no, sect, entry_key, 0 AS pos, v FROM entry WHERE sect IN ('labels', 'sitelinks') AND json_type(v) <> 'NULL'
  UNION ALL SELECT line_no, sect, entry_key, 0, v FROM entry WHERE sect IN ('aliases', 'claims') AND json_type(v) NOT IN ('NULL', 'ARRAY')
  UNION ALL SELECT line_no, sect, entry_key, p, json_extract(v, '$[' || p || ']') FROM (SELECT *, unnest(range(json_array_length(v)::BIGINT))::INT AS p FROM entry WHERE sect IN ('aliases', 'claims') AND json_type(v) = 'ARRAY')),
qual AS (SELECT line_no, entry_key, pos, unnest(json_keys(v, '$.qualifiers')) AS sub_key, v FROM element WHERE sect = 'claims' AND json_type(v, '$.qualifiers') = 'OBJECT'),
qv AS (SELECT line_no, entry_key, pos, sub_key, json_extract(v, '$.qualifiers."' || sub_key || '"') AS q FROM qual)
"""
ORACLE["p2_found"] = _DUMP + """
SELECT line_no, sect, entry_key, pos::INT AS pos, '' AS sub_key, -1 AS sub_pos FROM element
UNION ALL SELECT line_no, 'qualifiers', entry_key, pos, sub_key, unnest(range(CASE json_type(q) WHEN 'ARRAY' THEN json_array_length(q)::BIGINT WHEN 'NULL' THEN 0 ELSE 1 END::BIGINT))::INT FROM qv
"""
ORACLE["p2_claims"] = _DUMP + """
SELECT e.line_no, e.entry_key, e.pos::INT AS pos, sum(CASE WHEN q IS NULL OR json_type(q) = 'NULL' THEN 0 WHEN json_type(q) = 'ARRAY' THEN json_array_length(q)::BIGINT ELSE 1 END)::BIGINT AS n_qualifiers
FROM element e LEFT JOIN qv ON qv.line_no = e.line_no AND qv.entry_key = e.entry_key AND qv.pos = e.pos WHERE e.sect = 'claims' GROUP BY ALL
"""
ORACLE["p5_labels"] = f"""
WITH k AS (SELECT DISTINCT {_BARE.format('id')} AS i, 'en' AS l FROM lexicon_base WHERE enlabel IS NOT NULL UNION SELECT {_BARE.format('id')}, 'fr' FROM lexicon_base WHERE frlabel IS NOT NULL),
r AS (SELECT doc_id, {_BARE.format('item_id')} AS i, lower(lang) AS l FROM documents),
there AS (SELECT *, EXISTS (SELECT 1 FROM k WHERE k.i = r.i AND k.l = r.l) AS pair_there, EXISTS (SELECT 1 FROM k WHERE k.i = r.i) AS item_there, EXISTS (SELECT 1 FROM k WHERE k.l = r.l) AS lang_there FROM r)
SELECT doc_id, 'simple' AS match_kind FROM there WHERE i IS NOT NULL AND l IS NOT NULL AND NOT pair_there
UNION ALL SELECT doc_id, 'partial' FROM there WHERE CASE WHEN i IS NOT NULL AND l IS NOT NULL THEN NOT pair_there WHEN i IS NOT NULL THEN NOT item_there WHEN l IS NOT NULL THEN NOT lang_there ELSE false END
UNION ALL SELECT doc_id, 'full' FROM there WHERE CASE WHEN i IS NOT NULL AND l IS NOT NULL THEN NOT pair_there ELSE i IS NOT NULL OR l IS NOT NULL END"""
# depths go down from the roots; what they don't reach is closed over upwards, and a node in its own closure is on a circle
_LINKS = _DUMP.replace("WITH dump", "WITH RECURSIVE dump", 1) + f"""
, raw AS (SELECT json_extract_string(ok.j, '$.id') AS c, json_extract_string(e.v, '$.mainsnak.datavalue.value.id') AS p FROM element e JOIN ok USING (line_no)
  WHERE sect = 'claims' AND entry_key = 'P279' AND json_type(e.v, '$.mainsnak.datavalue.value') = 'OBJECT'),
pair AS (SELECT DISTINCT {_BARE.format('c')} AS c, {_BARE.format('p')} AS p FROM raw WHERE {_BARE.format('c')} IS NOT NULL AND {_BARE.format('p')} IS NOT NULL),
link AS (SELECT c, min(p) AS p FROM pair GROUP BY 1),
node AS (SELECT c AS id FROM link UNION SELECT p FROM link),
down AS (SELECT id, id AS root_id, 0 AS tree_depth, id AS tree_path FROM node WHERE id NOT IN (SELECT c FROM link)
  UNION ALL SELECT l.c, d.root_id, d.tree_depth + 1, d.tree_path || '/' || l.c FROM down d JOIN link l ON l.p = d.id),
below AS (SELECT l.p AS id, l.c AS descendant, 1 AS steps FROM link l JOIN down d ON d.id = l.c UNION ALL SELECT b.id, l.c, b.steps + 1 FROM below b JOIN link l ON l.p = b.descendant),
lost AS (SELECT id FROM node WHERE id NOT IN (SELECT id FROM down)),
up AS (SELECT id, p AS x FROM lost JOIN link ON c = id UNION SELECT up.id, l.p FROM up JOIN link l ON l.c = up.x),
ring AS (SELECT id FROM up WHERE id = x),
every AS (SELECT id, root_id, tree_depth, tree_path FROM down
  UNION ALL SELECT up.id, min(x), CASE WHEN up.id IN (SELECT id FROM ring) THEN -1 ELSE -2 END, NULL FROM up WHERE x IN (SELECT id FROM ring) GROUP BY up.id)
"""
ORACLE["p6_found"] = _LINKS + "SELECT id, root_id, tree_depth FROM every"
ORACLE["p6_tree"] = _LINKS + f"""SELECT every.id, root_id, tree_depth, tree_path, CASE WHEN tree_depth >= 0 THEN (SELECT count(*) FROM below WHERE below.id = every.id) END AS n_descendants, flagged
FROM every LEFT JOIN (SELECT {_BARE.format('ent_idx')} AS i, bool_or(is_subclass) AS flagged FROM entity_stats GROUP BY 1) f ON f.i = every.id"""
ORACLE["p6_descendants"] = _LINKS + "SELECT id, descendant, steps FROM below"
ORACLE["p6_other_parents"] = _LINKS + "SELECT pair.c AS id, pair.p AS parent FROM pair JOIN link USING (c) WHERE pair.p <> link.p"
