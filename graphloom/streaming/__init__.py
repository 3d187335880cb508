"""Dumps that arrive in pieces. The same row-wise operators run on a stream, as they keep no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.nested import shred


def dump_stream(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the parquet files that arrive in a folder."""
    return spark.readStream.schema("line_no long, dump_name string, read_at timestamp, line string").parquet(path)


def shred_stream(lines: DataFrame, paths: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Writes the flat nodes of all lines that are there, each once, by schema path, and ends."""
    nodes = shred(lines, "line_no", "line", paths)
    return nodes.writeStream.format("parquet").partitionBy("node_path").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
