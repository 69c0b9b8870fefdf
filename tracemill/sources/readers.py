"""Readers of problem sets, traces and pairs; each returns a DataFrame with a fixed schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions.text import first_filled, strip
from tracemill.operators.ranking import place_in_group

PROBLEM = "id string, problem string, answer string, entry_point string, test string, full_solution string, source_dataset string, source_split string"
PAIR = "problem_id string, problem string, prompt string, chosen string, rejected string, chosen_answer string, rejected_answer string, expected_answer string"


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped, or fail the read if strict."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def _numbered(df: DataFrame, order: str | None) -> DataFrame:
    """idx from 0 by a column that gives the order of the rows."""
    return place_in_group(df.withColumn("_all", F.lit(0)), "_all", order or "ord", place="idx").withColumn("idx", F.col("idx") - 1).drop("_all", "size")


def gsm8k(df: DataFrame, split: str, order: str = "ord", limit: int | None = None) -> DataFrame:
    """Problems of question and answer columns; the gold answer follows ####, or is the last line."""
    rows = _numbered(df, order) if limit is None else _numbered(df, order).where(F.col("idx") < limit)
    solution = F.col("answer")
    marked = F.replace(strip(F.regexp_extract(solution, r"####\s*(.+?)(?:\n|$)", 1)), F.lit(","), F.lit(""))
    last = strip(F.element_at(F.split(strip(solution), "\n"), -1))
    return rows.select(F.concat(F.lit(f"gsm8k_{split}_"), "idx").alias("id"), F.col("question").alias("problem"), F.when(solution.contains("####"), marked).otherwise(last).alias("answer"), solution.alias("full_solution"), F.lit("gsm8k").alias("source_dataset"), F.lit(split).alias("source_split"))


def humaneval(df: DataFrame) -> DataFrame:
    return df.select(F.col("task_id").alias("id"), F.col("prompt").alias("problem"), F.col("canonical_solution").alias("answer"), "entry_point", "test", F.lit("humaneval").alias("source_dataset"))


def mbpp(df: DataFrame, split: str) -> DataFrame:
    return df.select(F.concat(F.lit("mbpp_"), F.col("task_id")).alias("id"), F.col("text").alias("problem"), F.col("code").alias("answer"), F.array_join("test_list", "\n").alias("test"), F.lit("mbpp").alias("source_dataset"), F.lit(split).alias("source_split"))


def math(df: DataFrame, split: str, limit: int | None = None, level: str | None = None, subject: str | None = None, order: str = "ord") -> DataFrame:
    """Problems with a boxed answer. The limit comes before the filters on level and subject."""
    rows = _numbered(df, order)
    rows = rows if limit is None else rows.where(F.col("idx") < limit)
    rows = rows if level is None else rows.where(F.col("level").contains(level))
    rows = rows if subject is None else rows.where(F.lower("type") == subject.lower())
    return rows.select(F.concat(F.lit(f"math_{split}_"), "idx").alias("id"), "problem", F.regexp_extract("solution", r"\\boxed\{([^}]+)\}", 1).alias("answer"), F.col("solution").alias("full_solution"), "level", "type", F.lit("math").alias("source_dataset"), F.lit(split).alias("source_split"))


LOADERS: dict[str, Callable[..., DataFrame]] = {"gsm8k": gsm8k, "humaneval": humaneval, "mbpp": mbpp, "math": math}


def loader(name: str) -> Callable[..., DataFrame]:
    """The loader of a problem set, by name in any case."""
    try:
        return LOADERS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown problem set {name!r}; known: {', '.join(LOADERS)}") from None


def preference_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of prompt, chosen and rejected; records that lack one of these keys (problem may stand for prompt) are left out, nulls stay, and so are malformed lines."""
    lines = spark.read.text(path).select("value", F.json_object_keys("value").alias("keys"), F.from_json("value", PAIR).alias("r"))
    has = lambda k: F.array_contains("keys", k)
    kept = lines.where((has("prompt") | has("problem")) & has("chosen") & has("rejected")).select("r.*")
    return kept.withColumn("prompt", first_filled(F.col("prompt"), F.col("problem")))


def correct_samples(spark: SparkSession, path: str) -> DataFrame:
    """Prompt and response of correct samples; a missing is_correct counts as true."""
    df = jsonl(spark, path, "problem string, prompt string, reasoning string, response string, is_correct boolean")
    return df.where(F.coalesce("is_correct", F.lit(True))).select(first_filled(F.col("prompt"), F.col("problem")).alias("prompt"), first_filled(F.col("reasoning"), F.col("response")).alias("response"))


def shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All shards of a folder with the number in their file's name as shard."""
    df = spark.read.schema(schema).json(f"{folder}/*.jsonl", mode="DROPMALFORMED")
    return df.withColumn("shard", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*$", 1).try_cast("long"))


def held_out(problems: DataFrame, n: int) -> DataFrame:
    """The first n test problems by id, as prompt and answer."""
    return problems.where("source_split = 'test'").orderBy("id").limit(n).select(F.col("problem").alias("prompt"), "answer")


def kafka(spark: SparkSession, servers: str, topics: str, group: str, streaming: bool = True, **options: str) -> DataFrame:
    """Messages of Kafka topics from the earliest offset; needs the connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    for key, value in {"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": "earliest", "kafka.group.id": group, **options}.items():
        reader = reader.option(key, value)
    return reader.load()


def rotating(traces: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """For each wanted text, n of its stored outputs in turn; empty strings where there is none."""
    placed = place_in_group(traces.select("problem", "ord", "reasoning"), "problem", "ord", place="_place", size="_size")
    sizes = placed.where("_place = 1").select("problem", "_size")
    k = wanted.select("problem", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).join(sizes, "problem", "left").withColumn("_place", F.pmod("k", "_size") + 1)
    return k.join(placed.select("problem", "_place", "reasoning"), ["problem", "_place"], "left").select("problem", "k", F.coalesce("reasoning", F.lit("")).alias("output"))
