"""Receipts of finished runs: JSON records of a few kinds, read, checked by rules and written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.sinks import write_text

VERSION = "1"
SCHEMA = (
    "kind string, schema_version string, run_id string, timestamp_utc string, model string, benchmark string, n_problems long, n_samples long, wall_clock_seconds double, "
    "pairs array<struct<name: string, kappa: double, low: double, high: double, agreement: double>>, changes array<struct<name: string, applicable: double, retention: double, low: double, high: double>>, "
    "seeds array<long>, metrics map<string, double>"
)
#: What must hold for every receipt, and for each kind, by name; a rule that gives null is broken.
ALWAYS = {"version": f"schema_version = '{VERSION}'", "run": "run_id != ''", "time": "try_to_timestamp(timestamp_utc) IS NOT NULL", "problems": "n_problems >= 0", "seconds": "wall_clock_seconds >= 0"}
RULES = {
    "agreement": {"pairs": "size(pairs) > 0", "kappa": "forall(pairs, p -> p.kappa BETWEEN -1 AND 1)", "agreement": "forall(pairs, p -> p.agreement BETWEEN 0 AND 1)", "interval": "forall(pairs, p -> p.low <= p.high)"},
    "robustness": {"changes": "size(changes) > 0", "applicable": "forall(changes, c -> c.applicable BETWEEN 0 AND 1)", "retention": "forall(changes, c -> c.retention >= 0)", "interval": "forall(changes, c -> c.low <= c.high)"},
    "replication": {"seeds": "size(seeds) > 0 AND size(array_distinct(seeds)) = size(seeds)", "metrics": "size(metrics) > 0 AND forall(map_values(metrics), v -> NOT isnan(v))", "samples": "n_samples > 0"},
}


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Receipts of a path, one a file, with the names of the rules they break as faults; what is no JSON, or of no known kind, breaks kind."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", SCHEMA).alias("r")).select("path", "r.*")
    broken = [F.when(~F.coalesce(F.col("kind").isin(*RULES), F.lit(False)), "kind"), *(F.when(~F.coalesce(F.expr(e), F.lit(False)), n) for n, e in ALWAYS.items())]
    broken += [F.when((F.col("kind") == kind) & ~F.coalesce(F.expr(e), F.lit(False)), n) for kind, rules in RULES.items() for n, e in rules.items()]
    return files.withColumn("faults", F.array_compact(F.array(*broken)))


def write_receipt(spark: SparkSession, path: str, kind: str, **fields: object) -> None:
    """Write a receipt and read it again; one that breaks a rule raises and stays for inspection."""
    if kind not in RULES:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(RULES)}")
    write_text(spark, json.dumps({"kind": kind, "schema_version": VERSION, **fields}, indent=2), path)
    if faults := read_receipts(spark, path).first().faults:
        raise ValueError(f"receipt {path} breaks {', '.join(faults)}")
