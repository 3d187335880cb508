"""Queries for training data: terms, look-alikes, cut texts, packing, mixing and splitting."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import cut_texts, lookalike, mixing, packing, splitting, terms
from graphloom.llm.tokens import with_sizes
from graphloom.session import cut, table

LABELS = ("enlabel", "frlabel", "fraliase")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term of the labels with its counts, and the mark of those too rare or too common to be a key."""
    lex = table(spark, d, "lexicon_base")
    return terms.marked(terms.term_counts(lex, LABELS), lex.count())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The terms too rare or too common to be a key."""
    return p1_terms(spark, d).filter("mark IS NOT NULL")


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every label in the one form that all its look-alikes share."""
    return lookalike.unify(table(spark, d, "lexicon_base"), "row_id", LABELS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The labels that were off."""
    return p3_unified(spark, d).filter("is_off").select("row_id", "field_name", "pos")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose labels or id were stored without their end."""
    stats = table(spark, d, "entity_stats")
    lex = table(spark, d, "lexicon_base")
    languages = lex.select(F.col("enlabel").alias("value"), F.lit("en").alias("lang")).unionByName(lex.select(F.col("frlabel").alias("value"), F.lit("fr").alias("lang")))
    codes = cut(cut_texts.cut_codes(stats, "row_id", "ent_idx"))
    lists = cut_texts.cut_lists(stats, "row_id", "qlabels", "src_name", "ent_idx", codes, languages)
    return lists.withColumn("field_name", F.lit("qlabels")).unionByName(codes.withColumn("field_name", F.lit("ent_idx")))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """How many of each source's texts and ids were cut."""
    rows = table(spark, d, "entity_stats").select("row_id", "src_name", F.explode(F.array(F.lit("qlabels"), F.lit("ent_idx"))).alias("field_name"))
    found = p4_found(spark, d).withColumn("cut_here", F.lit(1))
    both = rows.join(found, ["row_id", "field_name"], "left")
    return both.groupBy("src_name", "field_name").agg(F.count("*").alias("n_rows"), F.count("cut_here").alias("n_cut"), F.round(F.count("cut_here") / F.count("*"), 6).alias("cut_rate"))


def _limits(spark: SparkSession, d: str, kind: str) -> list[tuple[str, int, int]]:
    rows = table(spark, d, "size_limits").filter(F.col("use_name").startswith(kind)).orderBy("use_name").collect()
    return [(r["use_name"], r["max_tokens"], r["overlap_tokens"] or 0) for r in rows]


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one larger than a container, and its container, for each container size."""
    sizes = cut(with_sizes(table(spark, d, "documents").select("doc_id", "text"), "text"))
    out = None
    for name, capacity, _ in _limits(spark, d, "pack_"):
        part = packing.pack(sizes, "doc_id", "n_tokens", capacity).withColumn("use_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def p8_room(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each size are."""
    limits = table(spark, d, "size_limits").select(F.col("use_name").alias("u"), "max_tokens")
    packed = p8_packed(spark, d).filter("piece_size > 0").groupBy("use_name").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("piece_size").alias("n_tokens"))
    return packed.join(limits, F.col("use_name") == F.col("u")).select("use_name", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("max_tokens")).alias("n_at_least"), F.round(F.col("n_tokens") / F.col("max_tokens") / F.col("n_containers"), 6).alias("fill"))


def p9_drawn(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn so that each source has its share: as many tokens as all documents of the weighed sources have."""
    docs = cut(with_sizes(table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("text_id"), "text"), "text"))
    weights = table(spark, d, "source_weights")
    total = docs.join(F.broadcast(weights.select(F.col("src_name").alias("source"))), "source", "left_semi").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return mixing.mix(docs, "doc_id", "text_id", "source", "n_tokens", weights, total=total)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source, the tokens it lacks to its target, and how often its documents are used at most."""
    drawn = p9_drawn(spark, d).groupBy("src_name").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_uses"), F.max("use_no").alias("most_uses"))
    both = cut(table(spark, d, "source_weights").join(drawn, "src_name", "left").fillna(0, ["n_tokens", "n_uses", "most_uses"]))
    total = F.lit(both.agg(F.sum("n_tokens")).first()[0])
    return both.select("src_name", "target_share", F.round(F.try_divide(F.col("n_tokens"), total), 6).alias("actual_share"), "n_tokens", F.greatest(F.lit(0), F.round(F.col("target_share") * total).cast("long") - F.col("n_tokens")).alias("shortfall"), "n_uses", "most_uses", "max_repeats")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every document for each piece limit."""
    return splitting.split_texts(table(spark, d, "documents"), "doc_id", "text", _limits(spark, d, "split_"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each container size: the documents placed, containers above it, and documents that fit but were split."""
    limits = table(spark, d, "size_limits").select(F.col("use_name").alias("u"), "max_tokens")
    packed = cut(p8_packed(spark, d))
    docs = packed.groupBy("use_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("piece_size").alias("n")).join(F.broadcast(limits), F.col("use_name") == F.col("u"))
    docs = docs.groupBy("use_name").agg(F.count("*").alias("n_docs"), F.sum(((F.col("pieces") > 1) & (F.col("n") <= F.col("max_tokens"))).cast("long")).alias("n_split"))
    room = packed.groupBy(F.col("use_name").alias("r"), "container_id").agg(F.sum("piece_size").alias("n")).join(F.broadcast(limits), F.col("r") == F.col("u"))
    room = room.groupBy("r").agg(F.sum((F.col("n") > F.col("max_tokens")).cast("long")).alias("n_over"))
    return docs.join(room, F.col("use_name") == F.col("r")).select("use_name", "n_docs", "n_split", "n_over")


def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each source: documents used more often than allowed, and uses of documents that aren't its own."""
    weights = table(spark, d, "source_weights").select("src_name", "max_repeats")
    drawn = p9_drawn(spark, d)
    own = table(spark, d, "documents").select(F.col("doc_id").alias("i"), "source")
    uses = drawn.join(own, F.col("doc_id") == F.col("i"), "left").groupBy(F.col("src_name").alias("s"), "doc_id").agg(F.count("*").alias("n"), F.sum((~F.col("source").eqNullSafe(F.col("src_name"))).cast("long")).alias("strange"))
    got = uses.join(F.broadcast(weights.withColumnRenamed("src_name", "w")), F.col("s") == F.col("w")).groupBy("s").agg(F.sum((F.col("n") > F.col("max_repeats")).cast("long")).alias("over"), F.sum("strange").alias("strange"))
    return weights.join(got, F.col("src_name") == F.col("s"), "left").select("src_name", F.coalesce("over", F.lit(0)).alias("n_over"), F.coalesce("strange", F.lit(0)).alias("n_strange"))


def p10_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each piece limit: documents with pieces, pieces above it, places where consecutive pieces share less than the overlap."""
    limits = table(spark, d, "size_limits").select(F.col("use_name").alias("u"), "max_tokens", "overlap_tokens")
    pieces = p10_pieces(spark, d).select("use_name", "doc_id", "piece_no", "start_token", "end_token", "n_tokens").join(F.broadcast(limits), F.col("use_name") == F.col("u"))
    before = F.lag("end_token").over(Window.partitionBy("use_name", "doc_id").orderBy("piece_no"))
    pieces = pieces.withColumn("shared", before - F.col("start_token"))
    first = (F.col("piece_no") == 0) & (F.col("start_token") == 0)
    return pieces.groupBy("use_name").agg(F.sum(first.cast("long")).alias("n_docs"), F.sum((F.col("n_tokens") > F.col("max_tokens")).cast("long")).alias("n_over"), F.sum(F.coalesce((F.col("shared") < F.col("overlap_tokens")).cast("long"), F.lit(0))).alias("n_short"))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p3_found, p3_unified, p4_found, p4_rates, p8_packed, p8_room, p9_drawn, p9_shares, p10_pieces, p8_invariants, p9_invariants, p10_invariants)}


def _folds() -> str:
    """The code points that form NFKC replaces, with what it puts there, as a SQL table (k, t)."""
    found = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    found = [(k, t) for k, t in found if k != t]
    text = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    return f"SELECT unnest({text(k for k, _ in found)}) AS k, unnest({text(t for _, t in found)}) AS t"


_TERMS = f"""WITH m AS ({_folds()}),
vals AS (SELECT row_id, unnest([enlabel, frlabel] || coalesce(fraliase, [])) AS v FROM lexicon_base),
one AS (SELECT v, string_split(v, '') AS l FROM (SELECT DISTINCT v FROM vals WHERE v <> '')),
ch AS (SELECT v, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM one),
fold AS (SELECT v, lower(nfc_normalize(string_agg(coalesce(m.t, ch.c), '' ORDER BY i))) AS f FROM ch LEFT JOIN m ON m.k = ch.c GROUP BY v),
occ AS (SELECT row_id, unnest(regexp_extract_all(f, '[\\p{{L}}\\p{{N}}\\p{{M}}]+')) AS term FROM vals JOIN fold USING (v)),
terms AS (SELECT term, count(*) AS n_occ, count(DISTINCT row_id) AS n_rows FROM occ GROUP BY term),
marked AS (SELECT *, CASE WHEN n_rows <= 2 THEN 'rare' WHEN n_rows > 0.03 * (SELECT count(*) FROM lexicon_base) THEN 'common' END AS mark FROM terms)
"""
ORACLE: dict[str, str] = {"p1_terms": _TERMS + "SELECT * FROM marked", "p1_found": _TERMS + "SELECT * FROM marked WHERE mark IS NOT NULL"}
ORACLE |= {
    "p8_invariants": "SELECT use_name, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_split, 0 AS n_over FROM size_limits WHERE use_name LIKE 'pack%'",
    "p9_invariants": "SELECT src_name, 0 AS n_over, 0 AS n_strange FROM source_weights",
    "p10_invariants": "SELECT use_name, (SELECT count(*) FROM documents WHERE text <> '') AS n_docs, 0 AS n_over, 0 AS n_short FROM size_limits WHERE use_name LIKE 'split%'",
}
