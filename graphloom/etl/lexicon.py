"""The lexicon: ranked items, their label variants, and from each variant the ids it may mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.skew import ordered_position
from graphloom.text import functions as T


def lexicon_base(items: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, enlabel, order, frlabel, fraliase, bridging) of ranked items with an English label; bridging lists an item's
    properties by rank. An item with a property that has no rank is left out."""
    base = items.filter("en IS NOT NULL").join(ranks.select(F.col("id").alias("r"), "order"), F.col("id") == F.col("r"))
    props = base.filter(F.col("id").startswith("Q")).select("id", F.explode("bridging").alias("p")).join(ranks.select(F.col("id").alias("p"), F.col("order").alias("po")), "p", "left")
    props = props.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("po", "p"))), lambda x: x["p"]).alias("bridging"), (F.count("*") == F.count("po")).alias("all_ranked"))
    out = base.drop("bridging").join(props.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
    return out.filter("all_ranked OR all_ranked IS NULL").select("id", F.col("en").alias("enlabel"), "order", F.col("local").alias("frlabel"), F.col("local_aliases").alias("fraliase"), "bridging")


def top(base: DataFrame, n: int = 1_000_000, order: str = "order", ties: Sequence[str] = ("id",)) -> DataFrame:
    """The n first rows by order, and by `ties` among equals."""
    return base.orderBy(order, *ties).limit(n)


def variants(base: DataFrame, title_case: bool = True) -> DataFrame:
    """base with `variant`: every label raw, in lower, title and capitalised case, each once; the plural of one-word English labels."""
    labels = F.array_distinct(F.array_compact(F.concat(F.array("enlabel", "frlabel"), F.coalesce("fraliase", F.array().cast("array<string>")))))
    rows = base.withColumn("label", F.explode(labels))
    forms = [F.col("label"), F.lower("label"), T.capitalize(F.col("label"))] + [T.title(F.col("label"))] * title_case
    single = (F.col("label") == F.col("enlabel")) & ~F.col("label").contains(" ") & (F.col("label") != "")
    plural = F.when(single, T.plural(F.col("label")))
    if title_case:  # a Python function is evaluated once a row, before the rows multiply
        rows = rows.withColumn("__title", forms[-1])
        forms[-1] = F.col("__title")
    out = rows.withColumn("variant", F.explode(F.array_distinct(F.array_compact(F.array(*forms, plural)))))
    return out.drop("label", "__title")


def dictionary(base: DataFrame, order: str, title_case: bool = True, normalized: bool = False) -> DataFrame:
    """(named_entity, pos, id): for every regular variant the ids in rank order, one row an id, so that a label of
    a third of all items makes no group to gather. Stop and question ids are left out."""
    kept = base.filter(~F.col("id").isin(*T.STOP_IDS, *T.WH_IDS))
    rows = variants(kept, title_case).filter(T.regular_label(F.col("variant")))
    named = F.array_join(T.words(F.col("variant")), " ") if normalized else F.col("variant")
    rows = rows.select(named.alias("named_entity"), "id", F.col(order).alias("__o")).groupBy("named_entity", "id").agg(F.min("__o").alias("__o"))
    return ordered_position(rows, ["named_entity"], "__o", ["id"], "pos").select("named_entity", "pos", "id")


def write_json(dictionary: DataFrame, bridging: DataFrame, path: str) -> None:
    """The dictionary as JSON lines {"named_entity": ..., "entity_list": {id: [properties]}} in rank order, absent lists empty.

    This format holds a key's ids in one line; it is for dictionaries whose keys have few.
    """
    rows = dictionary.join(bridging.select(F.col("id").alias("b"), "bridging"), F.col("id") == F.col("b"), "left")
    entry = F.struct("pos", "id", F.coalesce("bridging", F.array().cast("array<string>")).alias("bridging"))
    keys = rows.groupBy("named_entity").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    keys.select("named_entity", F.map_from_entries(F.transform("e", lambda x: F.struct(x["id"], x["bridging"]))).alias("entity_list")).write.json(path)
