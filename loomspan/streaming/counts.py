"""Streams: windowed counts, merged sessions, and coverage counted as reads arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, size: str = "1 hour", late: str = "2 hours", time: str = "ts", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Rows for each tumbling window and key; rows later than ``late`` are dropped once their window has closed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, gap: str = "5 minutes", late: str = "1 hour", time: str = "ts", key: str = "user_id") -> DataFrame:
    """A key's rows joined where they follow within ``gap``: the merge of intervals, over time."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def pack_counts(visits: DataFrame) -> DataFrame:
    """Coverage so far of each node, for ``complete`` or ``update`` output."""
    return visits.groupBy("node_id").agg(F.count("*").alias("cnt"))


def drained(result: DataFrame, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """All that is there now, run to its end into a memory table (for results of bounded size)."""
    name = f"loomspan_{uuid.uuid4().hex}"
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
