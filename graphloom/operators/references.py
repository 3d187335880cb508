"""References to records that do not exist, or did not exist at the time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def orphans(refs: DataFrame, keys: DataFrame, columns: Sequence[str], match: str = "simple", at: str | None = None, since: str | None = None, until: str | None = None, small: bool = False) -> DataFrame:
    """The rows of refs whose key, the given columns, exists in no row of keys.

    With `at` a referred row must also be valid at that time: since <= at < until, a null until being open. Both sides
    then meet in order of time, day by day, so that a key with a third of all references and lives isn't compared
    all with all. `small` says that keys are few, of a checked number, with few lives each: they are broadcast.

    Keys with nulls follow the declared match: 'simple' - a null anywhere refers to nothing and is no
    orphan; 'partial' - the non-null columns alone must occur; 'full' - all null refers to nothing, some
    null is an orphan. References are grouped by their mask of nulls and each mask is anti-joined on
    its own columns, a null `at` being one more column that isn't compared. Repeated references stay
    repeated, extra columns of refs are kept; rows of keys with a null in a compared column match nothing.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    compared = [*columns, *([at] if at else [])]
    out = None
    # one pass finds the masks that occur, 2^columns rows at most; each then costs one anti-join
    there = {tuple(r) for r in refs.select(*(F.col(c).isNull().alias(f"m{i}") for i, c in enumerate(compared))).distinct().collect()}
    for mask in sorted(there) or [(False,) * len(compared)]:
        nulls = [c for c, isnull in zip(compared, mask) if isnull]
        null_keys = [c for c in nulls if c in columns]
        rows = refs
        for c, isnull in zip(compared, mask):
            rows = rows.filter(F.col(c).isNull() if isnull else F.col(c).isNotNull())
        if len(null_keys) == len(columns) or (null_keys and match == "simple"):
            continue
        if not (null_keys and match == "full"):
            own = [c for c in columns if c not in nulls]
            timed = at if at and at not in nulls else None
            rows = _missing_in_time(rows, keys, own, timed, since, until) if timed and not small else _missing(rows, keys, own, timed, since, until, small)
        out = rows if out is None else out.unionByName(rows)
    return refs.limit(0) if out is None else out


def _missing(refs: DataFrame, keys: DataFrame, columns: Sequence[str], at: str | None, since: str | None, until: str | None, small: bool) -> DataFrame:
    own = keys.select(*(F.col(c).alias(f"__k_{c}") for c in columns), *((F.col(since).alias("__since"), F.col(until).alias("__until")) if at else ()))
    own = own.dropna(subset=[f"__k_{c}" for c in columns])
    on: Column | None = None
    for c in columns:
        term = F.col(c) == F.col(f"__k_{c}")
        on = term if on is None else on & term
    if at:
        on = on & (F.col("__since") <= F.col(at)) & (F.col("__until").isNull() | (F.col(at) < F.col("__until")))
    return refs.join(F.broadcast(own) if small else own, on, "left_anti")


def _missing_in_time(refs: DataFrame, keys: DataFrame, columns: Sequence[str], at: str, since: str, until: str) -> DataFrame:
    """The rows of refs (all compared columns there) for whose key no life begun by then lasts longer: the latest end of
    all lives begun is looked for inside (key, day), what earlier days bring comes from one row a key and day."""
    kind = refs.schema[at].dataType
    ends = F.coalesce(F.col(until), F.lit("9999-12-31").cast(kind))
    names = [f"__k{i}" for i in range(len(columns))]
    lives = keys.dropna(subset=[*columns, since]).groupBy(*(F.col(c).alias(n) for c, n in zip(columns, names)), F.col(since).cast(kind).alias("__t")).agg(F.max(ends).alias("__end"))
    asked = refs.select(*(F.col(c).alias(n) for c, n in zip(columns, names)), F.col(at).alias("__t"), F.struct(*refs.columns).alias("__row"))
    both = asked.unionByName(lives, allowMissingColumns=True).withColumn("__day", F.to_date("__t"))
    # lives come before references of the same time
    inside = Window.partitionBy(*names, "__day").orderBy("__t", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("__now", F.max("__end").over(inside)).filter("__row IS NOT NULL")
    days = lives.groupBy(*names, F.to_date("__t").alias("__d")).agg(F.max("__end").alias("__e"))
    open_now = both.filter("__now IS NULL OR __now <= __t")
    marks = open_now.select(*names, F.col("__day").alias("__d")).distinct().withColumn("__ask", F.lit(True))
    line = days.withColumn("__ask", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    # lives of the same day may begin after the reference: only those of earlier days count
    earlier = Window.partitionBy(*names).orderBy("__d", F.desc("__ask")).rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("__before", F.max("__e").over(earlier))
    before = line.filter("__ask").select(*(F.col(n).alias(f"{n}_b") for n in names), F.col("__d").alias("__db"), "__before")
    on = F.col("__day") == F.col("__db")
    for n in names:
        on = on & (F.col(n) == F.col(f"{n}_b"))
    rest = open_now.join(before, on, "left").filter("__before IS NULL OR __before <= __t")
    return rest.select("__row.*")


def lifetimes(log: DataFrame, key: str, act: str, when: str, order: str, ends: Sequence[str] = ("delete",)) -> DataFrame:
    """(key, since, until): when each id was alive, from a log of acts that may be delivered twice or late.

    An act holds from its own time, whenever it was received, to the next act of the id; of acts at one time the one
    with the largest `order` holds. An act in `ends` ends life, any other act begins or goes on with it.
    Entries with a null id or time say nothing.

    The next act is looked for inside (id, day) first; only one row a day and id meets in the second
    window, so an id with a third of all entries is spread over its days.
    """
    rows = log.filter(F.col(key).isNotNull() & F.col(when).isNotNull())
    rows = rows.groupBy(F.col(key).alias("id"), F.col(when).alias("since")).agg(F.max_by(F.col(act), F.struct(order)).alias("act"))
    rows = rows.withColumn("day", F.to_date("since"))
    firsts = rows.groupBy("id", "day").agg(F.min("since").alias("first"))
    firsts = firsts.select(F.col("id").alias("__i"), F.col("day").alias("__m"), F.lead("first").over(Window.partitionBy("id").orderBy("day")).alias("__later"))
    rows = rows.withColumn("__next", F.lead("since").over(Window.partitionBy("id", "day").orderBy("since")))
    rows = rows.join(firsts, (F.col("id") == F.col("__i")) & (F.col("day") == F.col("__m")))
    return rows.filter(F.col("act").isNull() | ~F.col("act").isin(*ends)).select(F.col("id").alias(key), "since", F.coalesce("__next", "__later").alias("until"))
