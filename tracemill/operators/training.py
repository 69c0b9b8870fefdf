"""Inputs and summaries of training runs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups(pairs: DataFrame) -> DataFrame:
    """Per prompt: ordered chosen and rejected texts and the first expected answer; groups with neither prompt nor substance are left out."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda s: s["v"])
    g = pairs.where("prompt is not null and prompt != ''").groupBy("prompt").agg(ordered("chosen").alias("chosen"), ordered("rejected").alias("rejected"), F.min_by("expected", F.when(F.col("expected").isNotNull(), F.col("ord"))).alias("expected"))
    return g.where(F.col("expected").isNotNull() | (F.size("chosen") > 0))


def advantages(rewards: DataFrame, group: str = "problem_id", reward: str = "reward", least: float = 1e-6) -> DataFrame:
    """Rewards less the group's mean, by its population deviation; groups without spread, and null ones, are left out.

    The groups are aggregated and joined back, so that a crowded one is never in
    one task.
    """
    g = rewards.groupBy(group).agg(F.avg(reward).alias("mean"), F.stddev_pop(reward).alias("sd")).where(F.col("sd") >= least)
    return rewards.join(g, group).withColumn("advantage", (F.col(reward) - F.col("mean")) / (F.col("sd") + 1e-8))


def step_labels(steps: DataFrame) -> DataFrame:
    """Labels of the steps of chosen and rejected texts (key, side, i, label): in a rejected text all from the first error on are 0; other unverified steps are left out."""
    w = Window.partitionBy("key", "side").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failed = (F.max(F.when(F.col("label") == 0, 1).otherwise(0)).over(w) == 1) & (F.col("side") == "rejected")
    return steps.withColumn("label", F.when(failed, 0).otherwise(F.col("label"))).where("label is not null")


def best_checkpoint(history: DataFrame, least: float, patience: int = 0) -> DataFrame:
    """Per run: the last score that beat the best so far by more than least, its step and the evaluations since.

    The bar depends on the last accepted score, so this is a fold over the
    ordered scores of a run. With a patience the fold ends, at the step stopped,
    once so many evaluations in a row brought nothing.
    """
    ordered = F.array_sort(F.collect_list(F.struct("step", "score")))
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(None).cast("double").alias("score"), none.alias("step"), F.lit(0).alias("since"), none.alias("stopped"))

    def merge(acc: Column, x: Column) -> Column:
        better = acc["score"].isNull() | (x["score"] > acc["score"] + least)
        over = F.when(F.lit(patience > 0) & (acc["since"] + 1 >= patience), x["step"])
        waited = F.struct(acc["score"].alias("score"), acc["step"].alias("step"), (acc["since"] + 1).alias("since"), over.alias("stopped"))
        return F.when(acc["stopped"].isNotNull(), acc).when(better, F.struct(x["score"].alias("score"), x["step"].alias("step"), F.lit(0).alias("since"), none.alias("stopped"))).otherwise(waited)

    best = history.where("score is not null").groupBy("run").agg(F.aggregate(ordered, start, merge).alias("b"))
    return best.select("run", "b.score", "b.step", "b.since", *(["b.stopped"] if patience else []))


def running_median(rows: DataFrame) -> DataFrame:
    """Rows (ord, part, n) with the median of all n of the part so far, in order of ord, rounded down; null n are passed over.

    A fold over sorted rows, with the lower and the upper half in heaps.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, low, high = object(), [], []
        for frame in frames:
            medians = []
            for p, n in zip(frame["part"], frame["n"].tolist()):
                if p != part:
                    part, low, high = p, [], []
                if not pd.isna(n):
                    heapq.heappush(high, -heapq.heappushpop(low, -int(n)))
                    if len(high) > len(low):
                        heapq.heappush(low, -heapq.heappop(high))
                medians.append(None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) // 2)
            yield frame.assign(median=pd.array(medians, dtype="Int64"))

    typed = rows.select(F.col("ord").cast("long"), F.col("part").cast("string"), F.col("n").cast("long"))
    return typed.repartition("part").sortWithinPartitions("part", "ord").mapInPandas(run, "ord long, part string, n long, median long")


def equation_label(step: Column) -> Column:
    """1 if the step's only a op b = c holds, 0 if not, null if there is none."""
    pattern = r"(-?\d+(?:\.\d+)?)\s*([-+*/])\s*(-?\d+(?:\.\d+)?)\s*=\s*(-?\d+(?:\.\d+)?)"
    a, op, b, c = (F.regexp_extract(step, pattern, k) for k in range(1, 5))
    a, b, c = (F.nullif(x, F.lit("")).cast("double") for x in (a, b, c))
    value = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).otherwise(F.try_divide(a, b))
    return F.when(~step.rlike(pattern), None).otherwise(F.coalesce((F.abs(value - c) < 1e-6).cast("int"), F.lit(0)))
