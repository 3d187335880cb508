"""Readers and writers of the formats around the graph; those of questions, lexicons and trees are with their subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dump(spark: SparkSession, path: str, name: str = "dump") -> DataFrame:
    """(line_no, dump_name, line) of a dump, a JSON array with an item a line; plain, gzip or bz2, of which bz2 is split.

    Line numbers grow with the file's order and are unique, but have gaps.
    """
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.lit(name).alias("dump_name"), F.col("value").alias("line"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(id, score) of lines with an id and a score; others are left out."""
    cols = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(F.get(cols, F.lit(0)).alias("id"), F.get(cols, F.lit(1)).try_cast("double").alias("score")).filter("id <> '' AND score IS NOT NULL")


def write_scores(scores: DataFrame, path: str) -> None:
    scores.select(F.concat_ws("\t", "id", F.col("score").cast("string"))).write.mode("overwrite").text(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines with two numbers."""
    return spark.read.schema("src long, dst long").option("sep", " ").csv(path).dropna()


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "dst")).write.mode("overwrite").text(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """Triples by property, so that a query reads only the properties it names."""
    triples.write.mode("overwrite").partitionBy("p").parquet(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("s", "p", "o", "o_num", "o_str", "o_date")


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines without the fields that are null."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_paths(paths: DataFrame, path: str, column: str = "path_ids") -> None:
    """Statement paths, one a line, ids parted by blanks. Null paths and ids have no line."""
    rows = paths.filter(F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | x.rlike(r"\s")))
    rows.select(F.array_join(column, " ")).write.mode("overwrite").text(path)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path_ids) of the lines with three to five ids."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("path_ids")).filter(F.size("path_ids").between(3, 5))


def write_index(index: DataFrame, path: str) -> None:
    """(id, node) as lines of id, tab, number."""
    index.select(F.concat_ws("\t", "id", F.col("node").cast("string"))).write.mode("overwrite").text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, node long").option("sep", "\t").option("quote", "").csv(path).filter("node IS NOT NULL")


# Widths in bytes of the text columns of the entity store.
ENTITY_WIDTHS = {"ent_idx": 16, "qlabels": 9000}


def write_entities(rows: DataFrame, path: str, widths: dict[str, int] = ENTITY_WIDTHS, mode: str = "append") -> None:
    """Rows of the entity table added to the store, or in its place with mode 'overwrite'. A text wider than its column is an error, so that nothing is cut silently."""
    checked = rows
    for name, width in widths.items():
        wide = F.raise_error(F.concat(F.lit(f"{name} wider than {width} bytes: "), F.substring(name, 1, 40))).cast("string")
        checked = checked.withColumn(name, F.when(F.octet_length(name) > width, wide).otherwise(F.col(name)))
    checked.write.mode(mode).parquet(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
