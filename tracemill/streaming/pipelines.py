"""Structured Streaming stages over trace messages and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.streaming.messages import TOPICS, envelope, open_envelope


def stage(messages: DataFrame, data_schema: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Messages opened, transformed by fn on their data, empty results dropped."""
    opened = open_envelope(messages, data_schema).select("key", "data.*")
    return fn(opened).na.drop("all")


def bridge(messages: DataFrame, data_schema: str, fn: Callable[[DataFrame], DataFrame], kind: str, at: Column | None = None) -> DataFrame:
    """Messages of one topic, worked on by fn, as messages of the topic of kind; their key stays."""
    done = stage(messages, data_schema, fn)
    return envelope(done.select("key", F.struct(*(c for c in done.columns if c != "key")).alias("data")), TOPICS[kind], kind, at)


def run_bounded(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, most: int) -> int:
    """Give sink the rows that are there until it has had most of them, and stop at the first batch that reaches it or when nothing is left; how many it had.

    Rows beyond most in the last batch are not given and count as read.
    """
    had = 0

    def some(batch: DataFrame, number: int) -> None:
        nonlocal had
        part = batch.limit(most - had).persist() if had < most else None
        if part is not None:
            try:
                had += part.count()
                sink(part, number)
            finally:
                part.unpersist()

    query = stream.writeStream.foreachBatch(some).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while query.isActive and had < most:
        query.awaitTermination(1)
    query.stop()
    return had


def first_seen(stream: DataFrame, key: str, at: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each key; with a time column, keys are forgotten when the watermark has passed."""
    return stream.dropDuplicates([key]) if at is None else stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there in micro-batches, then stop; sink gets each batch and its number and may see one twice."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def tumbling(stream: DataFrame, at: str, size: str, keys: list[str], aggs: dict[str, Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Named aggregates by time window and keys; rows behind the watermark are dropped."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    out = stream.withWatermark(at, late).groupBy(window, *keys).agg(*(c.alias(n) for n, c in aggs.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggs)


def sessions(stream: DataFrame, at: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Sessions of each key that end after a gap, with their number of rows."""
    s = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")
