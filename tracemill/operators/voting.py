"""Voting over the answers of several traces of one problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_index(traces: DataFrame, most: int) -> DataFrame:
    """The first most traces of each problem with their place k, from 0; each task keeps no more of a problem before the shuffle."""
    k = F.row_number().over(Window.partitionBy("problem_id").orderBy("ord"))
    return traces.withColumn("k", k).where(F.col("k") <= most).withColumn("k", F.col("k") - 1)


def pass_at(traces: DataFrame, ks: tuple[int, ...] = (1, 4, 8)) -> DataFrame:
    """(k, problems, passed, rate): problems with a correct trace among their first k."""
    first = sample_index(traces, max(ks)).where(F.col("is_correct")).groupBy("problem_id").agg(F.min("k").alias("first"))
    problems = traces.select("problem_id").distinct().join(first, "problem_id", "left")
    counts = problems.agg(F.count(F.lit(1)).alias("problems"), *(F.count_if(F.col("first") < k).alias(f"p{k}") for k in ks))
    rows = counts.select("problems", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("passed")) for k in ks))))
    return rows.withColumn("rate", F.round(F.coalesce(F.try_divide("passed", "problems"), F.lit(0.0)), 9))


def votes(traces: DataFrame, answer: str = "answer") -> DataFrame:
    """(problem_id, answer, n, first, score): votes of each answer, its first trace and the sum of scores."""
    return traces.where(F.col(answer).isNotNull()).groupBy("problem_id", F.col(answer).alias("answer")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.sum("score").alias("score"))


def majority(counted: DataFrame) -> DataFrame:
    """The answer with most votes of each problem, the first seen on ties, with its share."""
    w = Window.partitionBy("problem_id")
    ranked = counted.withColumns({"rank": F.row_number().over(w.orderBy(F.col("n").desc(), "first")), "total": F.sum("n").over(w)})
    return ranked.where("rank = 1").select("problem_id", "answer", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"), "first")


def weighted(counted: DataFrame) -> DataFrame:
    """The answer with the greatest sum of scores, the first seen on ties."""
    rank = F.row_number().over(Window.partitionBy("problem_id").orderBy(F.round("score", 6).desc(), "first"))
    return counted.withColumn("rank", rank).where("rank = 1").select("problem_id", "answer", F.round("score", 6).alias("score"))


def best_of(traces: DataFrame) -> DataFrame:
    """The trace with the greatest score of each problem, the first on ties."""
    rank = F.row_number().over(Window.partitionBy("problem_id").orderBy(F.round("score", 6).desc(), "ord"))
    return traces.withColumn("rank", rank).where("rank = 1").select("problem_id", "ord", F.round("score", 6).alias("score"))


def samples_needed(traces: DataFrame, batch: int = 8, most: int = 64) -> DataFrame:
    """(problem_id, samples, solved): samples drawn in batches until one is correct."""
    t = sample_index(traces, most).groupBy("problem_id").agg(F.min(F.when(F.col("is_correct"), F.col("k"))).alias("first"), F.count(F.lit(1)).alias("n"))
    drawn = F.ceil((F.col("first") + 1) / batch).cast("long") * batch
    return t.select("problem_id", F.coalesce(drawn, F.lit(most).cast("long")).alias("samples"), F.col("first").isNotNull().alias("solved"))
