"""The knowledge base: triples, names and the forms of query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.kb.compiler import OBJECT, compile_formula
from graphloom.lang.parser import Context, parse, standard_context
from graphloom.lang.terms import Term
from graphloom.session import table

#: Types of the values of the properties that the driver's tables make, other than entities.
TABLE_TYPES = {"P8": "num", "P9": "num", "P10": "d", "P11": "s"}
TAGS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6}


def entity_id(kind: str, key):
    return F.concat(F.lit("Q"), (F.lit(TAGS[kind]).cast("long") * 1_000_000_000 + F.col(key).cast("long")).cast("string"))


class KnowledgeBase:
    """Queries over distinct triples (s, p, o, o_num, o_str, o_date).

    Each property of a query is a scan of the triples filtered on p; triples stored with partitionBy('p') are
    pruned to it. limit=None returns all answers; with a limit they are ordered first, so the same ones come back. Formulas whose parts
    share no variable are refused unless `products` allows all combinations.
    """

    def __init__(self, triples: DataFrame, context: Context | None = None, labels: DataFrame | None = None, products: bool = False) -> None:
        self.triples = triples
        self.products = products
        self.context = context or standard_context()
        self.labels = labels

    def define(self, text: str) -> None:
        parse(text, self.context)

    def term(self, text: str | Term, mark: str = "all") -> Term:
        return parse(text, self.context, mark) if isinstance(text, str) else text

    def bindings(self, text: str | Term, mark: str = "all") -> DataFrame:
        """All bindings of the answer variables, repeated as often as the formula holds."""
        rows, answers, scope = compile_formula(self.term(text, mark), self.triples, self.products)
        if rows is None:
            kinds = {"e": "string", "num": "double", "s": "string", "d": "date"}
            return self.triples.sparkSession.createDataFrame([], ", ".join(f"{a} {kinds[scope.types[a]]}" for a in answers))
        missing = [a for a in answers if a not in rows.columns]
        if missing:
            raise ValueError(f"answers that nothing restricts: {missing}")
        return rows.select(*answers)

    def query(self, text: str | Term, limit: int | None = 1000, mark: str = "all", with_labels: bool = False) -> DataFrame:
        """SELECT: the distinct answers."""
        out = self.bindings(text, mark).distinct()
        if with_labels and self.labels is not None:
            for c in out.columns:
                out = out.join(self.labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")), c, "left")
        return out if limit is None else out.orderBy(*out.columns).limit(limit)

    def count(self, text: str | Term) -> DataFrame:
        """How many bindings the answer has, repeated ones counted."""
        rows = self.bindings(text)
        return rows.agg(F.count(rows.columns[0]).alias("n"))

    def count_distinct(self, text: str | Term) -> DataFrame:
        rows = self.bindings(text)
        return rows.agg(F.count_distinct(*rows.columns).alias("n"))

    def ask(self, text: str | Term) -> DataFrame:
        """One row: whether the formula holds at all."""
        rows, _, _ = compile_formula(self.term(text), self.triples, self.products)
        spark = self.triples.sparkSession
        if rows is None:
            return spark.range(1).select(F.lit(False).alias("answer"))
        return rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))

    def top(self, text: str | Term, k: int = 1, offset: int = 0, largest: bool = True) -> DataFrame:
        """The answers (first variable) with the largest or smallest quantity (second variable); ties by id."""
        rows = self.bindings(text).distinct()
        x, v = rows.columns
        order = [F.desc(v) if largest else F.asc(v), F.asc(x)]
        out = rows.orderBy(*order)
        return (out.offset(offset) if offset else out).limit(k)

    @staticmethod
    def from_tables(spark: SparkSession, d: str) -> KnowledgeBase:
        """The graph of the driver's tables: P1 class, P2 customer-nation, P3 supplier-nation, P4 nation-region, P5
        order-customer, P6 order-part, P7 part-supplier, P8 balance, P9 total, P10 date, P11 name."""
        null = {"o": "string", "o_num": "double", "o_str": "string", "o_date": "date"}

        def make(rows: DataFrame, p: str, s, o, kind: str = "o") -> DataFrame:
            return rows.select(s.alias("s"), F.lit(p).alias("p"), *((o if c == kind else F.lit(None)).cast(t).alias(c) for c, t in null.items())).filter(F.col("s").isNotNull() & F.col(kind).isNotNull())

        t = {n: table(spark, d, n) for n in (*TAGS, "lineitem")}
        key = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
        parts = [make(t[n], "P1", entity_id(n, key[n]), F.lit(f"Q{TAGS[n]}")) for n in TAGS]
        parts += [
            make(t["customer"], "P2", entity_id("customer", "c_custkey"), entity_id("nation", "c_nationkey")),
            make(t["supplier"], "P3", entity_id("supplier", "s_suppkey"), entity_id("nation", "s_nationkey")),
            make(t["nation"], "P4", entity_id("nation", "n_nationkey"), entity_id("region", "n_regionkey")),
            make(t["orders"], "P5", entity_id("orders", "o_orderkey"), entity_id("customer", "o_custkey")),
            make(t["lineitem"], "P6", entity_id("orders", "l_orderkey"), entity_id("part", "l_partkey")).distinct(),
            make(t["lineitem"], "P7", entity_id("part", "l_partkey"), entity_id("supplier", "l_suppkey")).distinct(),
            make(t["customer"], "P8", entity_id("customer", "c_custkey"), F.col("c_acctbal"), "o_num"),
            make(t["supplier"], "P8", entity_id("supplier", "s_suppkey"), F.col("s_acctbal"), "o_num"),
            make(t["orders"], "P9", entity_id("orders", "o_orderkey"), F.col("o_totalprice"), "o_num"),
            make(t["orders"], "P10", entity_id("orders", "o_orderkey"), F.col("o_orderdate").cast("date"), "o_date")]
        names = {"region": "r_name", "nation": "n_name", "customer": "c_name", "supplier": "s_name", "part": "p_name"}
        parts += [make(t[n], "P11", entity_id(n, key[n]), F.col(c), "o_str") for n, c in names.items()]
        triples = parts[0]
        for x in parts[1:]:
            triples = triples.unionByName(x)
        labels = triples.filter("p = 'P11'").select(F.col("s").alias("id"), F.col("o_str").alias("label"))
        return KnowledgeBase(triples, standard_context(TABLE_TYPES), labels)


assert set(OBJECT.values()) == {"o", "o_num", "o_str", "o_date"}
