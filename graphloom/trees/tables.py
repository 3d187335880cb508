"""Trees in DataFrames: node tables, spans, scores and transformed text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.trees import tree as T

NODE = "tree_id long, node_id int, parent_id int, child_ord int, label string, is_leaf boolean, leaf_lo int, leaf_hi int"

# The sections of the usual split.
TRAIN, DEV, TEST = range(2, 22), 24, 23


def parse_trees(df: DataFrame, key: str, text: str) -> DataFrame:
    """The node table of bracketed trees, node ids in preorder, 0 the root. Null and malformed texts give no nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    root = T.read(s) if s else None
                except T.TreeError:
                    root = None
                if root is None:
                    continue
                nodes: list[list] = []

                def go(x: T.Tree, parent: int | None, place: int, leaf: int, k=k, nodes=nodes) -> int:
                    me = len(nodes)
                    nodes.append([k, me, parent, place, x.label, x.is_leaf, leaf, leaf + 1])
                    end = leaf + 1 if x.is_leaf else leaf
                    for i, kid in enumerate(x.kids):
                        end = go(kid, me, i, end)
                    nodes[me][7] = end
                    return end

                go(root, None, 0, 0)
                rows += nodes
            cols = list(zip(*rows)) or [[] for _ in range(8)]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=[f.split(" ")[0] for f in NODE.split(", ")])

    return df.select(F.col(key).cast("long").alias("tree_id"), text).mapInArrow(run, NODE)


def transformed(text: Column, f: Callable[[T.Tree], T.Tree | None]) -> Column:
    """The bracketed text of each tree after a transformation; null for what is malformed or left empty."""

    def one(s: str | None) -> str | None:
        if not s:
            return None
        try:
            out = f(T.read(s))
        except T.TreeError:
            return None
        return None if out is None else str(out)

    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return F.pandas_udf(apply, StringType())(text)


def spans(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree_id", "leaf_lo", "leaf_hi", "label").distinct()


def score(gold: DataFrame, got: DataFrame) -> DataFrame:
    """(tree_id, prec, recall, f1) of node tables over the same trees, by their sets of spans."""
    a, b = spans(gold).withColumn("g", F.lit(1)), spans(got).withColumn("h", F.lit(1))
    both = a.join(b, ["tree_id", "leaf_lo", "leaf_hi", "label"], "full").groupBy("tree_id").agg(F.count("g").alias("g"), F.count("h").alias("h"), F.count(F.col("g") + F.col("h")).alias("m"))
    p, r = F.coalesce(F.try_divide("m", "h"), F.lit(0.0)), F.coalesce(F.try_divide("m", "g"), F.lit(0.0))
    return both.select("tree_id", p.alias("prec"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def category_counts(nodes: DataFrame) -> DataFrame:
    """Nonterminals after tags are stripped: a node above nothing but one leaf doesn't count unless it is the root."""
    kids = nodes.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("arity"), F.bool_and("is_leaf").alias("leafy"))
    inner = nodes.filter("NOT is_leaf").join(kids, ["tree_id", "node_id"]).filter("NOT (arity = 1 AND leafy) OR parent_id IS NULL")
    return inner.groupBy("label").agg(F.count("*").alias("n"))


def leaf_tokens(nodes: DataFrame) -> DataFrame:
    return nodes.filter("is_leaf").select("tree_id", F.col("leaf_lo").alias("pos"), F.col("label").alias("form"))


def pos_tags(nodes: DataFrame) -> DataFrame:
    leaves = nodes.filter("is_leaf").select("tree_id", F.col("parent_id").alias("node_id"), F.col("leaf_lo").alias("pos"), F.col("label").alias("form"))
    arity = nodes.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    single = leaves.join(arity.filter("n = 1"), ["tree_id", "node_id"])
    return single.join(nodes.select("tree_id", "node_id", F.col("label").alias("tag")), ["tree_id", "node_id"]).select("tree_id", "pos", "form", "tag")


def oov(tokens: DataFrame, lexicon: DataFrame, unknown: str = "<unk>") -> DataFrame:
    known = lexicon.select(F.col("form").alias("__f")).distinct()
    return tokens.join(known, F.col("form") == F.col("__f"), "left").withColumn("form", F.when(F.col("__f").isNull(), unknown).otherwise(F.col("form"))).drop("__f")


def split_of(section: Column) -> Column:
    return F.when(section.between(TRAIN[0], TRAIN[-1]), "train").when(section == DEV, "dev").when(section == TEST, "test")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(file, tree): the trees of all files of a directory, one text each; a file is read whole."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, t) for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in T.flatten(v.splitlines(True))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["file", "tree"])

    return files.mapInArrow(run, "file string, tree string")


def write_split(trees: DataFrame, section: str, text: str, path: str) -> None:
    """Trees and their raw text by split: path/split=train/..."""
    out = trees.withColumn("split", split_of(F.col(section))).filter("split IS NOT NULL")
    out.select("split", F.col(text).alias("tree"), transformed(F.col(text), lambda t: T.Tree(" ".join(t.leaves()))).alias("raw")).write.mode("overwrite").partitionBy("split").json(path)
