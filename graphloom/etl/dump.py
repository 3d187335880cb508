"""Items of the dump, the filters and the statement paths taken from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.nested import read_object, strings
from graphloom.text.functions import HUMAN_CLASSES

ITEM = "line_no long, id string, nclaims long, nlanguages long, nsitelinks long, is_instance boolean, is_subclass boolean, en string, local string, local_aliases array<string>, classes array<string>, bridging array<string>, paths array<array<string>>"


def _map(x) -> dict:
    return x if isinstance(x, dict) else {}


def _list(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _value(snak):
    data = _map(_map(snak).get("datavalue"))
    return data.get("value")


def _entity(value) -> str | None:
    got = _map(value).get("id")
    return got if isinstance(got, str) else None


def statement_paths(item: str, claims: dict) -> list[list[str]]:
    """[s, p, o], or with a qualifier [s, p, o, q, o2]; [s, p, q, o2] where the main value is no entity.

    Only a qualifier's first value counts. Beside an entity a qualifier that is no entity gives [s, p, o] again, one
    without a value gives nothing.
    """
    out = []
    for p, statements in claims.items():
        for st in _list(statements):
            st = _map(st)
            o = _entity(_value(st.get("mainsnak")))
            quals = [(q, _value(_list(v)[0]) if _list(v) else None) for q, v in _map(st.get("qualifiers")).items()]
            if o is not None and not quals:
                out.append([item, p, o])
            for q, v in quals:
                o2 = _entity(v)
                if v is None:
                    continue
                if o is not None:
                    out.append([item, p, o] + ([q, o2] if o2 else []))
                elif o2:
                    out.append([item, p, q, o2])
    return out


def read_items(lines: DataFrame, lang: str = "fr") -> DataFrame:
    """One row a readable item (see ITEM): counts, labels in English and `lang`, classes, properties, paths.

    Unreadable lines and items without an id give nothing.
    """
    def label(labels: dict, code: str) -> str | None:
        got = labels.get(code)
        got = got.get("value") if isinstance(got, dict) else got
        return got if isinstance(got, str) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
        names = [c.split(" ", 1) for c in ITEM.split(", ")]
        for b in batches:
            rows = []
            for n, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = read_object(line)
                if x is None or not isinstance(x.get("id"), str):
                    continue
                labels, claims = _map(x.get("labels")), _map(x.get("claims"))
                aliases = [a.get("value") if isinstance(a, dict) else a for a in _list(_map(x.get("aliases")).get(lang))]
                rows.append((n, x["id"], len(claims), len(labels), len(_map(x.get("sitelinks"))), "P31" in claims, "P279" in claims, label(labels, "en"), label(labels, lang), [a for a in aliases if isinstance(a, str)],
                             [e for st in _list(claims.get("P31")) if (e := _entity(_value(_map(st).get("mainsnak"))))], list(claims), statement_paths(x["id"], claims)))
            cols = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([strings(list(c)) if t == "string" else pa.array(list(c), kinds[t]) for (_, t), c in zip(names, cols)], names=[n for n, _ in names])

    return lines.select(F.col("line_no").cast("long"), "line").mapInArrow(run, ITEM)


def relevant(id: Column | str = "id") -> Column:
    """Items with a language, a sitelink and a claim, and P31 or P279; properties the same without sitelinks."""
    i = F.col(id) if isinstance(id, str) else id
    full = (F.col("nlanguages") >= 1) & (F.col("nclaims") >= 1) & (F.coalesce("is_instance", F.lit(False)) | F.coalesce("is_subclass", F.lit(False)))
    return full & F.when(i.startswith("Q"), F.col("nsitelinks") >= 1).otherwise(i.startswith("P"))


def label_bundle(*labels: Column, aliases: Column) -> Column:
    """Labels and aliases, each once, without nulls."""
    return F.array_distinct(F.array_compact(F.concat(F.array(*labels), F.coalesce(aliases, F.array().cast("array<string>")))))


def entity_rows(items: DataFrame) -> DataFrame:
    """Rows of the entity table: relevant items with an English label."""
    kept = items.filter(relevant() & F.col("en").isNotNull())
    return kept.select(F.col("id").alias("ent_idx"), F.array_join(label_bundle(F.col("en"), F.col("local"), aliases=F.col("local_aliases")), ";").alias("qlabels"), "nclaims", "nlanguages", "nsitelinks", "is_instance", "is_subclass", F.lit(0.0).alias("neg_page_rank"))


def paths(items: DataFrame) -> DataFrame:
    return items.filter(relevant() & F.col("en").isNotNull()).select(F.col("id").alias("item_id"), F.explode("paths").alias("path_ids"))


def longest_labels(rows: DataFrame) -> DataFrame:
    """(most_bytes): the size of the longest label list, which a fixed-width store has to hold; 0 for none."""
    return rows.agg(F.coalesce(F.max(F.octet_length("qlabels")), F.lit(0)).alias("most_bytes"))


def humans(items: DataFrame, classes: Sequence[str] = HUMAN_CLASSES) -> DataFrame:
    """(id, names) of instances of one of the classes: the label in the language of reading, or else in English, and aliases."""
    return items.filter(F.exists("classes", lambda c: c.isin(*classes))).select("id", label_bundle(F.coalesce("local", "en"), aliases=F.col("local_aliases")).alias("names"))
