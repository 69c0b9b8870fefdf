"""Writers of pairs, samples, shards and run records."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.text import first_filled, legacy_id
from tracemill.runtime import interim_table


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def run_outputs(samples: DataFrame, pairs: DataFrame, folder: str, kept: DataFrame | None = None, smart: DataFrame | None = None) -> None:
    """All, filtered, correct and incorrect samples, the pairs whole, smart, and as prompt, chosen and rejected, and their counts.

    Samples are written once and read back for what is taken from them. kept and
    smart stand for the filtered samples and the smart pairs, where there are any.
    """
    spark = samples.sparkSession
    json_lines(samples, f"{folder}/all_samples")
    back = spark.read.schema(samples.schema).json(f"{folder}/all_samples")
    json_lines(back.where("is_correct"), f"{folder}/correct_samples")
    json_lines(back.where("not is_correct"), f"{folder}/incorrect_samples")
    json_lines(pairs, f"{folder}/full_pairs")
    json_lines(dpo_columns(pairs), f"{folder}/dpo_pairs")
    for name, df in (("filtered_samples", kept), ("smart_pairs", smart)):
        if df is not None:
            json_lines(df, f"{folder}/{name}")
    counts = back.agg(F.count(F.lit(1)).alias("samples"), F.count_if("is_correct").alias("correct"), F.count_if(~F.col("is_correct")).alias("incorrect"))
    json_lines(counts.crossJoin(pairs.agg(F.count(F.lit(1)).alias("pairs"))).coalesce(1), f"{folder}/stats")


def dpo_columns(pairs: DataFrame) -> DataFrame:
    prompt = first_filled(F.col("prompt"), F.col("problem")) if "prompt" in pairs.columns else F.col("problem")
    return pairs.select(prompt.alias("prompt"), "chosen", "rejected")


def _path(spark: SparkSession, path: str):
    """A path of the session's file system, and that file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def held_keys(spark: SparkSession, folder: str, key: str = "pair_id") -> DataFrame | None:
    """The keys that the shards of a folder hold, on any file system; None if there are none yet."""
    path, fs = _path(spark, f"{folder.rstrip('/')}/shard=*")
    return spark.read.parquet(*[str(s.getPath()) for s in found]).select(key) if (found := fs.globStatus(path)) else None


def append_new(pairs: DataFrame, folder: str, key: str = "pair_id", rows: int = 1_000_000) -> int:
    """Append the pairs whose key the folder doesn't hold yet, the first of each; how many the folder gained.

    Each call writes one shard, named by how many rows the folder holds with it,
    in files of up to rows rows. Null keys are left out. An empty gain writes
    nothing. Works on whatever file system the folder is on.
    """
    spark = pairs.sparkSession
    fresh = pairs.where(F.col(key).isNotNull()).dropDuplicates([key])
    old = held_keys(spark, folder, key)
    fresh = interim_table(fresh if old is None else fresh.join(old, key, "left_anti"), "fresh")
    gained = fresh.count()
    if gained:
        path, fs = _path(spark, f"{folder.rstrip('/')}/shard=*")
        total = gained + max([int(str(s.getPath()).rsplit("shard=", 1)[1]) for s in fs.globStatus(path) or []], default=0)
        fresh.write.mode("errorifexists").option("maxRecordsPerFile", rows).parquet(f"{folder.rstrip('/')}/shard={total:012}")
    return gained


def replace_path(df: DataFrame, path: str) -> None:
    """Put df in the place of a Parquet path that it may be read from: written beside it, then renamed, with what was there before kept once as .bak."""
    spark = df.sparkSession
    new, old, kept = (f"{path.rstrip('/')}{end}" for end in (".new", "", ".bak"))
    df.write.mode("overwrite").parquet(new)
    target, fs = _path(spark, old)
    backup = _path(spark, kept)[0]
    if fs.exists(target):
        if fs.exists(backup):
            fs.delete(target, True)
        else:
            fs.rename(target, backup)
    fs.rename(_path(spark, new)[0], target)


def is_v1(df: DataFrame) -> bool:
    """Whether pairs have the form of records with pair and provenance."""
    return {"pair", "provenance"} <= set(df.columns)


def migrate_path(spark: SparkSession, path: str, at: str) -> bool:
    """Bring a Parquet path of flat pairs to the form of records, in place; false if it has that form already."""
    df = spark.read.parquet(path)
    if is_v1(df):
        return False
    replace_path(migrate_pairs(df, at), path)
    return True


def confusion_files(counts: DataFrame, folder: str, name: str) -> None:
    """A JSON file per pair of raters of the counts tp, fp, fn and tn, as a two by two matrix; null counts are 0."""
    cell = lambda c: F.coalesce(c, F.lit(0))
    matrix = F.array(F.array(cell("tp"), cell("fp")), F.array(cell("fn"), cell("tn")))
    json_lines(counts.select("pair", matrix.alias("matrix"), "kappa").repartition(1, "pair"), f"{folder}/{name}")


def shortcut_lines(judged: DataFrame, path: str) -> None:
    """The rows that the verifier accepts (b) and a judge rejects (a), as JSON lines with their reason."""
    json_lines(judged.where(F.col("b") & ~F.col("a")).withColumn("reason", F.coalesce("reason_code", F.lit("OTHER"))).drop("reason_code"), path)


def outcome_lines(outcomes: DataFrame, path: str) -> None:
    """Outcomes of problems under changes, as JSON lines in folders by change."""
    outcomes.write.mode("errorifexists").option("ignoreNullFields", "false").partitionBy("change").json(path)


def markdown_table(df: DataFrame, title: str, most: int = 200) -> str:
    """A heading and a table of a small result, in the order of its first columns; more than most rows are told, not shown."""
    rows = df.orderBy(*df.columns[:2]).limit(most + 1).collect()
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows[:most])]
    return "\n".join([*lines, *(["", f"More than {most} rows."] if len(rows) > most else []), ""])


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A text file on any file system; one that is there is replaced."""
    target, fs = _path(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def point_to_latest(spark: SparkSession, folder: str, run: str) -> None:
    """Make latest.json of a folder name a run."""
    write_text(spark, json.dumps({"run": run, "at": _now()}), f"{folder.rstrip('/')}/latest.json")


def checkpoint_of(spark: SparkSession, folder: str) -> str | None:
    """The best checkpoint of a run's folder, else its final one; None if it has neither."""
    for name in ("best_checkpoint", "final"):
        path, fs = _path(spark, f"{folder.rstrip('/')}/{name}")
        if fs.exists(path):
            return str(path)
    return None


def training_step(spark: SparkSession, folder: str, step: int, **values: float) -> None:
    """One step of a training log, as a JSON line of its own file, so that writers never share one."""
    write_text(spark, json.dumps({"step": step, **values}) + "\n", f"{folder.rstrip('/')}/step={step:012}.json")


def migrate_pairs(df: DataFrame, at: str) -> DataFrame:
    """Flat pairs of the old form as records of pair, provenance and quality; quality stays null and the backend is legacy."""
    c = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    prompt = first_filled(c("prompt"), c("problem"))
    pid = first_filled(c("problem_id"), legacy_id(F.coalesce(prompt, F.lit(""))))
    pair = F.struct(pid.alias("problem_id"), prompt.alias("problem"), prompt.alias("prompt"), c("chosen").alias("chosen"), c("rejected").alias("rejected"))
    provenance = F.struct(pid.alias("problem_id"), F.lit("legacy").alias("generator_backend"), F.lit(at).alias("generated_at"), F.lit("1").alias("schema_version"))
    return df.select(pair.alias("pair"), provenance.alias("provenance"), F.lit(None).cast("double").alias("quality_score"))


def publish(messages: DataFrame, servers: str, **options: str) -> None:
    """Write messages of topic, key and value to Kafka; needs the connector on the class path."""
    writer = messages.select("topic", F.col("key").cast("string").alias("key"), "value").write.format("kafka").option("kafka.bootstrap.servers", servers)
    for key, value in {"kafka.acks": "all", "kafka.compression.type": "gzip", **options}.items():
        writer = writer.option(key, value)
    writer.save()


def flatten_numbers(record: dict, prefix: str = "") -> dict[str, float]:
    """Dotted keys of the numbers of a nested record; booleans are left out."""
    out: dict[str, float] = {}
    for key, value in record.items():
        if isinstance(value, dict):
            out |= flatten_numbers(value, f"{prefix}{key}.")
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            out[prefix + key] = float(value)
    return out


class RunRecord:
    """Manifest, artifacts, metrics and notes of one run, in one JSON file on the driver."""

    def __init__(self, folder: str, name: str) -> None:
        self.path = os.path.join(folder, "run_summary.json")
        self.body: dict = {"name": name, "started_at": _now(), "status": "running", "artifacts": [], "metrics": {}, "notes": []}
        os.makedirs(folder, exist_ok=True)
        self._write()

    def _write(self) -> None:
        with open(self.path + ".tmp", "w") as out:
            json.dump(self.body, out, indent=2)
        os.replace(self.path + ".tmp", self.path)

    def artifact(self, kind: str, path: str) -> None:
        self.body["artifacts"].append({"kind": kind, "path": path})
        self._write()

    def metrics(self, **values: float) -> None:
        self.body["metrics"] |= values
        self._write()

    def note(self, text: str) -> None:
        self.body["notes"].append(text)
        self._write()

    def finish(self, status: str = "success") -> dict:
        self.body |= {"status": status, "finished_at": _now()}
        self._write()
        return self.body


def run_stages(record: RunRecord, stages: dict[str, Callable[[], object]]) -> int:
    """Run stages one after another, each timed; one that fails is noted and the others go on, so that what was made stays. 0 if all went well, else 1."""
    failed = 0
    for name, stage in stages.items():
        began = time.perf_counter()
        try:
            stage()
        except Exception as e:
            failed = 1
            record.note(f"{name} failed: {type(e).__name__}: {e}")
        record.metrics(**{f"{name}_s": round(time.perf_counter() - began, 3)})
    record.finish("failed" if failed else "success")
    return failed


def _now() -> str:
    return datetime.now(UTC).replace(microsecond=0).isoformat()


def newest_summary(spark: SparkSession, glob: str) -> DataFrame:
    """The summary file changed last."""
    files = spark.read.text(glob, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"))
    return files.orderBy(F.col("at").desc(), "path").limit(1)
