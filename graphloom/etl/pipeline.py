"""From a dump to a dictionary in one call."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import sources
from graphloom.etl import dump, lexicon
from graphloom.graph import rank

#: Parts of the average score to which scores must differ to count as different, so that ranks are the same in every run.
TIES = 1e-9


def stable_ranks(scores: DataFrame) -> DataFrame:
    """(id, score, order): ranks of scores that sum to 1, those closer than TIES of their average by id."""
    n = scores.count()
    rounded = scores.withColumn("score", F.round(F.col("score") * n / TIES) * (TIES / max(1, n)))
    return rank.ranked(rounded, ["id"])


def run(lines: DataFrame, out: str, lang: str = "fr", mode: int = 1, top: int | None = None) -> dict[str, float]:
    """Writes entities, paths, node index, numbered edges, scores, lexicon base and dictionary below the folder `out`, each from the
    table before it, and returns the seconds that each took. `top` keeps so many best-ranked items of the lexicon base.
    """
    spark, took = lines.sparkSession, {}

    def step(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        start = time.time()
        make().write.mode("overwrite").parquet(f"{out}/{name}")
        took[name] = time.time() - start
        return spark.read.parquet(f"{out}/{name}")

    items = step("items", lambda: dump.read_items(lines, lang))
    start = time.time()
    sources.write_entities(dump.entity_rows(items), f"{out}/entities", {}, "overwrite")
    took["entities"] = time.time() - start
    paths = step("paths", lambda: dump.paths(items))
    index = step("index", lambda: rank.node_index(paths))
    links = rank.edges(paths, mode)
    step("edges", lambda: rank.number_edges(links, index))
    scores = step("scores", lambda: rank.pagerank(links))
    ranks = step("ranks", lambda: stable_ranks(scores))
    best = lambda base: base if top is None else lexicon.top(base, top)
    base = step("lexicon_base", lambda: best(lexicon.lexicon_base(items, ranks)))
    step("dictionary", lambda: lexicon.dictionary(base, "order"))
    return took
