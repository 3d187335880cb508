"""Edges of statement paths and the rank of their nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import dense_index
from graphloom.session import cut


def edges(paths: DataFrame, mode: int = 1, path: str = "path_ids") -> DataFrame:
    """Distinct (src, dst) of the paths. Mode 1: neighbours along a path; mode 2: those and shortcuts between the
    entities, 0-2 in a path of 3, 0-3 of 4, 0-2, 0-4 and 2-4 of 5. Null paths and paths of one give none."""
    p = F.col(path)
    at = lambda i: F.get(p, F.lit(i))
    pair = lambda a, b: F.struct(at(a).alias("src"), at(b).alias("dst"))
    chain = F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("src"), F.get(p, i + 1).alias("dst")))
    found = chain
    if mode == 2:
        short = F.when(F.size(p) == 3, F.array(pair(0, 2))).when(F.size(p) == 4, F.array(pair(0, 3))).when(F.size(p) == 5, F.array(pair(0, 2), pair(0, 4), pair(2, 4)))
        found = F.concat(chain, F.coalesce(short, F.array().cast("array<struct<src:string,dst:string>>")))
    rows = paths.filter(p.isNotNull() & (F.size(p) > 1)).select(F.explode(found).alias("e")).select("e.src", "e.dst")
    return rows.filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def nodes(paths: DataFrame, path: str = "path_ids") -> DataFrame:
    return paths.select(F.explode(path).alias("id")).filter("id IS NOT NULL").distinct()


def node_index(paths: DataFrame, path: str = "path_ids") -> DataFrame:
    """(id, node): every node with a number from 0, by id."""
    return dense_index(nodes(paths, path), ["id"], "node")


def number_edges(edges: DataFrame, index: DataFrame) -> DataFrame:
    """(src, dst) as the numbers of `index` (id, node); an edge with an end that has no number is left out."""
    ends = lambda n: index.select(F.col("id").alias(f"__{n}"), F.col("node").alias(n))
    rows = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return rows.join(ends("src"), F.col("a") == F.col("__src")).join(ends("dst"), F.col("b") == F.col("__dst")).select("src", "dst")


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-5, check_every: int = 10, max_rounds: int = 200, rounds: int | None = None) -> DataFrame:
    """(id, score), scores summing to 1. The score of nodes without outgoing edges goes to all alike.

    Stops when the scores change by less than `tolerance` in all, looked at every `check_every` rounds, or after exactly
    `rounds`; scores that haven't settled after max_rounds are an error. A hot target is pre-aggregated before the shuffle, a hot source is what adaptive execution splits in the
    join; each round's scores are kept in the shared folder and the round before's removed.
    """
    e = edges.select(F.col("src").alias("s"), F.col("dst").alias("d")).filter("s IS NOT NULL AND d IS NOT NULL").distinct()
    out = e.groupBy("s").agg(F.count("*").alias("deg"))
    links = cut(e.join(out.withColumnRenamed("s", "__s"), F.col("s") == F.col("__s")).select("s", "d", "deg"))
    ids = cut(links.select(F.explode(F.array("s", "d")).alias("id")).distinct().join(out.select(F.col("s").alias("__s"), F.lit(False).alias("__has")), F.col("id") == F.col("__s"), "left").select("id", F.col("__has").isNull().alias("dangling")))
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("score"))
    scores = cut(ids.withColumn("score", F.lit(1.0 / n)))
    k = 0
    while k < (rounds if rounds is not None else max_rounds):
        k += 1
        lost = scores.filter("dangling").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("x")).first()["x"]
        given = links.join(scores.select("id", "score"), F.col("s") == F.col("id")).groupBy("d").agg(F.sum(F.col("score") / F.col("deg")).alias("got"))
        new = ids.join(given, F.col("id") == F.col("d"), "left").select("id", "dangling", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        check = rounds is None and k % check_every == 0
        old, scores = scores, cut(new, None if check else scores)
        if check:
            moved = scores.join(old.select(F.col("id").alias("__i"), F.col("score").alias("__o")), F.col("id") == F.col("__i")).agg(F.sum(F.abs(F.col("score") - F.col("__o")))).first()[0]
            if moved < tolerance:
                break
    else:
        if rounds is None:
            raise RuntimeError(f"scores still change by {tolerance} or more after {max_rounds} rounds")
    return scores.select("id", "score")


def ranked(scores: DataFrame, ties: list[str]) -> DataFrame:
    """scores with `order`: 0-based position by falling score."""
    return dense_index(scores, [F.desc("score"), *ties], "order")
