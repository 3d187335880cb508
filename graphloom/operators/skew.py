"""Hot keys: finding the few that hold much of a table, and running sums that no single group can overload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

#: Sub-groups into which prefix_sum cuts every group.
BUCKETS = 256


def prefix_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str | Column, out: str, buckets: int = BUCKETS, last: Column | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same group that come before.

    The order inside a group is (hash bucket of `order`, `order`): fixed by the data, the same
    in every run, and free of any meaning. Each group is cut into `buckets` sub-groups that are summed
    on their own; only their totals (at most `buckets` a group) meet in one window. A group with a
    third of all rows therefore runs in `buckets` tasks. Rows for which `last` holds, which must be few, come after
    all others. Null values count as 0; a null group key is a group.
    """
    v = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0)).cast("long")
    part = [*group, "__bucket"]
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets))
    rows = df.withColumn("__bucket", bucket if last is None else F.when(last, F.lit(buckets).cast("long")).otherwise(bucket)).withColumn("__v", v)
    inner = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__in", F.sum("__v").over(inner) - F.col("__v"))
    outer = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(*part).agg(F.sum("__v").alias("__t"))
    totals = totals.withColumn("__before", F.sum("__t").over(outer) - F.col("__t"))
    names = {c: f"__g{i}" for i, c in enumerate(part)}
    totals = totals.select(*(F.col(c).alias(n) for c, n in names.items()), "__before")
    on = None
    for c, n in names.items():
        term = F.col(c).eqNullSafe(F.col(n))
        on = term if on is None else on & term
    done = rows.join(totals, on).withColumn(out, F.col("__in") + F.col("__before"))
    return done.drop("__bucket", "__v", "__in", "__before", *names.values())


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def ordered_position(df: DataFrame, group: Sequence[str], order: str, ties: Sequence[str], out: str, width: int = 4096) -> DataFrame:
    """Adds `out`: each row's place, from 0, in its group by `order` (a whole number) and then `ties`.

    Rows are ranked inside runs of `width` order values; only the runs' row counts meet in one window, so a group
    with a third of all rows is spread over its runs. Null orders come last.
    """
    run = F.coalesce(F.floor(F.col(order) / width), F.lit(2**62))
    part = [*group, "__run"]
    rows = df.withColumn("__run", run).withColumn("__in", F.row_number().over(Window.partitionBy(*part).orderBy(F.asc_nulls_last(order), *ties)) - 1)
    names = {c: f"__g{i}" for i, c in enumerate(part)}
    totals = df.withColumn("__run", run).groupBy(*part).agg(F.count("*").alias("__t"))
    before = F.sum("__t").over(Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__t")
    totals = totals.withColumn("__before", before).select(*(F.col(c).alias(n) for c, n in names.items()), "__before")
    on = None
    for c, n in names.items():
        term = F.col(c).eqNullSafe(F.col(n))
        on = term if on is None else on & term
    return rows.join(totals, on).withColumn(out, F.col("__in") + F.col("__before")).drop("__run", "__in", "__before", *names.values())


def dense_index(df: DataFrame, order: Sequence[Column | str], out: str, partitions: int | None = None) -> DataFrame:
    """Adds `out`: 0..n-1 in the given order over the whole table, without one task for all of it.

    The table is range-partitioned and kept; each partition is numbered on its own and starts where those
    before it end. The order should be total. Comes to the driver: one row a partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    kept = cut(df.repartitionByRange(n, *cols).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["count"] for r in kept.groupBy("__part").count().collect()}
    starts, at = [0] * n, 0
    for p in range(n):
        starts[p] = at
        at += sizes.get(p, 0)
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*cols))
    return kept.withColumn(out, F.element_at(F.lit(starts), F.col("__part") + 1).cast("long") + inside - 1).drop("__part")
