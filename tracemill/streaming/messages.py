"""Messages of the trace topics: key, JSON value of type, data and timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Topics and the type of their messages.
TOPICS = {"raw_reasoning": "reasoning-raw", "verified_path": "reasoning-verified", "training_sample": "training-data"}


def envelope(rows: DataFrame, topic: str, kind: str, at: Column | None = None) -> DataFrame:
    """(topic, key, value) of rows with key and a struct data; at is the time in seconds, now by default. Nulls stay in the JSON."""
    when = F.unix_micros(F.current_timestamp()) / 1_000_000.0 if at is None else at
    value = F.to_json(F.struct(F.lit(kind).alias("type"), "data", when.alias("timestamp")), {"ignoreNullFields": "false"})
    return rows.select(F.lit(topic).alias("topic"), "key", value.alias("value"))


def open_envelope(messages: DataFrame, data_schema: str, keep_bad: bool = False) -> DataFrame:
    """Messages with type, data and timestamp read from value; values that are no JSON object are left out, or kept with null type."""
    read = F.from_json(F.col("value").cast("string"), f"type string, data struct<{data_schema.replace(' ', ':', 1) if ',' not in data_schema else ', '.join(p.strip().replace(' ', ':', 1) for p in data_schema.split(','))}>, timestamp double")
    opened = messages.withColumn("_read", read).select(*[c for c in messages.columns if c != "value"], "_read.type", "_read.data", "_read.timestamp")
    return opened if keep_bad else opened.where("type is not null")
