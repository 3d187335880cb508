"""Reading tables and cutting lineage, the same in tests and on a cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where nothing is configured (tests, a laptop) is a folder of our own set,
    and removed at exit.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, own, True)
        at = "file://" + own
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


_kept: dict[int, tuple[DataFrame, str]] = {}


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df, computed once and kept as a table in the shared folder; a lost executor costs nothing of it.

    A table, not checkpoint(): it brings fresh sizes for the planner, where a checkpoint carries estimates on
    that multiply with every self-join of a loop. The table of `instead_of`, an earlier result of this
    function that nothing will read any more, is removed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _kept[id(out)] = (out, path)
    if instead_of is not None:
        drop(instead_of)
    return out


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed with the tables of cut."""
    path = f"{shared_folder(spark)}/graphloom-{uuid.uuid4().hex}"
    marker = spark.range(0)
    _kept[id(marker)] = (marker, path)
    return path


@contextmanager
def released() -> Iterator[None]:
    """Removes at its end what cut and scratch wrote inside; results of queries must have been read or written by then."""
    before = set(_kept)
    try:
        yield
    finally:
        for df, _ in [x for k, x in _kept.items() if k not in before]:
            drop(df)


def drop(df: DataFrame) -> None:
    """Removes the table behind a result of cut."""
    held = _kept.pop(id(df), None)
    if held:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(held[1])
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
