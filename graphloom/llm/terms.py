"""How often every distinct term of a collection occurs, and in how many rows.

Terms are counted inside each task first. The partial counts are parted by the bits of a hash; parts that
are too large are split by further bits until each fits; DuckDB then adds up each part on its own, out
of core. A part that no bits split holds one hot term's counts: those are added up in every task first. No dictionary of all
terms exists anywhere.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, shared_folder

#: Terms a task holds before it hands its partial counts over.
HELD = 200_000
#: Hash bits looked at in one round, and rounds at most: 48 bits part any number of distinct terms.
BITS, DEPTH = 12, 4
#: Partial counts that one part may hold.
PART_ROWS = 2_000_000
#: Memory of one DuckDB, beyond which it writes to the shared folder; where that is no mounted one it has nowhere to write.
PART_MEMORY, UNMOUNTED_MEMORY = "256MB", "1GB"
#: Bytes of a term that count as one partial count more.
LONG_TERM = 64


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex

    runs = regex.compile(r"[\p{L}\p{N}\p{M}]+")
    occ: Counter[str] = Counter()
    rows: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        terms = list(occ)
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([occ[t] for t in terms], pa.int64()), pa.array([rows[t] for t in terms], pa.int64())], names=["term", "n_occ", "n_rows"])
        occ.clear()
        rows.clear()
        return out

    for batch in batches:
        for values in batch.column(0).to_pylist():
            found: list[str] = []
            for v in values or ():
                if v:
                    found += runs.findall(v.lower() if v.isascii() else unicodedata.normalize("NFKC", v).lower())
            occ.update(found)
            rows.update(set(found))
            if len(occ) >= HELD:
                yield flush()
    if occ:
        yield flush()


def _split(sizes: dict[int, int], bits: int, limit: int, prefix: int = 0, used: int = 0) -> tuple[list[tuple[int, int]], list[int]]:
    """Prefixes (value, bits) of parts within the limit, by recursion over the hash's bits; and the full
    prefixes that are still too large."""
    total = sum(n for h, n in sizes.items() if h >> (bits - used) == prefix) if used else sum(sizes.values())
    if total <= limit:
        return [(prefix, used)], []
    if used == bits:
        return [], [prefix]
    parts, large = [], []
    for b in (0, 1):
        p, x = _split({h: n for h, n in sizes.items() if h >> (bits - used - 1) == prefix * 2 + b}, bits, limit, prefix * 2 + b, used + 1)
        parts += p
        large += x
    return parts, large


def _radix(counts: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """counts with the number of the part of each row, and how many parts there are; -1 where all bits are alike and still too many."""
    digit = lambda level: F.shiftrightunsigned(F.col("h"), 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)
    n = 0

    def level_part(rows: DataFrame, level: int) -> Column:
        nonlocal n
        sizes = {r["d"]: r["size"] for r in rows.groupBy(digit(level).cast("int").alias("d")).agg(F.sum("size").alias("size")).collect()}  # 2^BITS rows at most
        parts, large = _split(sizes, BITS, limit)
        place = [-1] * (1 << BITS)
        for prefix, used in parts:
            for h in range(prefix << (BITS - used), (prefix + 1) << (BITS - used)):
                place[h] = n
            n += 1
        out = F.element_at(F.lit(place), digit(level).cast("int") + 1)
        if level < DEPTH - 1:
            for p in large:
                out = F.when(digit(level) == p, level_part(rows.filter(digit(level) == p), level + 1)).otherwise(out)
        return out

    part = level_part(counts, 0)
    return counts.withColumn("part", part.cast("int")), n


def _adder(spill: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        # without a mounted shared folder nothing is written anywhere: a part's size is bounded
        at = f"{spill}/{uuid.uuid4().hex}" if spill else ""
        settings = {"memory_limit": PART_MEMORY if spill else UNMOUNTED_MEMORY, "threads": 1, "preserve_insertion_order": False, "temp_directory": at}
        with duckdb.connect(":memory:", config=settings) as con:
            con.execute("CREATE TABLE partial (term VARCHAR, n_occ BIGINT, n_rows BIGINT)")
            batch = first
            while batch is not None:
                con.register("batch", pa.Table.from_batches([batch]))
                con.execute("INSERT INTO partial SELECT * FROM batch")
                con.unregister("batch")
                batch = next((b for b in batches if b.num_rows), None)
            yield from con.sql("SELECT term, sum(n_occ)::BIGINT AS n_occ, sum(n_rows)::BIGINT AS n_rows FROM partial GROUP BY term").to_arrow_reader(100_000)

    return run


def term_counts(df: DataFrame, fields: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """(term, n_occ, n_rows) for every distinct term in the given text or text-array columns.

    A value is put in form NFKC and lower-cased; its terms are the maximal runs of letters, numbers
    and marks. n_occ counts occurrences in all fields, n_rows the rows with at least one. Null values, null
    elements, empty texts and texts without a letter or number hold no terms; repeated rows count again; an
    empty table gives an empty one. Other columns of df aren't read.
    """
    kinds = dict(df.dtypes)
    values = F.concat(*(F.coalesce(F.col(f), F.array().cast("array<string>")) if kinds[f].startswith("array") else F.array(F.col(f)) for f in fields))
    partial = df.select(values.alias("v")).mapInArrow(_partials, "term string, n_occ long, n_rows long")
    partial = cut(partial.withColumn("h", F.xxhash64("term")).withColumn("size", 1 + F.floor(F.octet_length("term") / LONG_TERM)))
    spread = 2 * df.sparkSession.sparkContext.defaultParallelism
    total = partial.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    limit = max(1, min(part_rows, total // spread))
    parted, n = _radix(partial, limit)
    shared = shared_folder(df.sparkSession)
    spill = "/" + shared[5:].lstrip("/") if shared.startswith("file:") else None
    cool = parted.filter("part >= 0").repartitionById(max(1, n), F.col("part")).select("term", "n_occ", "n_rows").mapInArrow(_adder(spill), "term string, n_occ long, n_rows long")
    hot = parted.filter("part < 0").groupBy("term").agg(F.sum("n_occ").alias("n_occ"), F.sum("n_rows").alias("n_rows"))
    return cool.unionByName(hot)


def marked(terms: DataFrame, n_rows: int, rare: int = 2, common: float = 0.03) -> DataFrame:
    """terms with `mark`: 'rare' in at most `rare` rows, 'common' in more than that share of all rows, else null.

    A term that is both (in a tiny table) is rare.
    """
    return terms.withColumn("mark", F.when(F.col("n_rows") <= rare, "rare").when(F.col("n_rows") > common * n_rows, "common"))
