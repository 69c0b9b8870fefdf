"""Normalised traces with features, and the filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.runtime import compute_once


def features(traces: DataFrame, problems: DataFrame) -> DataFrame:
    """Traces with tidy text, steps, has_answer, repetitive, words, n_words, answer_key, expected_key and failure mode."""
    expected = problems.select(F.col("id").alias("problem_id"), X.answer_key(F.col("answer")).alias("expected_key"))
    tidy = compute_once(traces, {"text": X.normalize(F.col("reasoning"))})
    text = F.col("text")
    parts = {"steps": X.step_count(text), "has_answer": X.has_final_answer(text), "words": X.words(text), "sentences": X.long_sentences(text), "key_source": X.first_filled(F.col("final_answer"), text)}
    full = compute_once(compute_once(tidy, parts), {"repetitive": X.is_repetitive(F.col("sentences"), F.col("words")), "answer_key": X.answer_key(F.col("key_source")), "n_words": F.size("words")})
    full = full.drop("sentences", "key_source").join(expected, "problem_id", "left")
    mode = (
        F.when(F.col("n_words") < 12, "trivial_short")
        .when(~F.col("has_answer"), "missing_final_answer")
        .when(F.col("repetitive"), "repetitive")
        .when(F.col("answer_key") != F.col("expected_key"), "answer_mismatch")
        .when(F.col("answer_key").isNull(), "parse_like_failure")
        .otherwise("reasoning_gap")
    )
    return full.withColumn("mode", mode)


def quality_reject(steps: Column, has_answer: Column, repetitive: Column, least_steps: int = 2) -> Column:
    """The first reason to reject a trace by quality, or null."""
    return F.when(steps < least_steps, "no_steps").when(~has_answer, "no_answer").when(repetitive, "repetitive")


def length_reject(text: Column, words: Column, chars: tuple[int, int] = (100, 8000), counts: tuple[int, int] = (50, 2048)) -> Column:
    """The first reason to reject a trace by length, or null; the bounds are kept."""
    n, w = F.length(text), F.size(words)
    return F.when(n < chars[0], "too_short").when(n > chars[1], "too_long").when(w < counts[0], "too_few_tokens").when(w > counts[1], "too_many_tokens")


def reject_reason() -> Column:
    """Quality first, then length, on a frame of features."""
    return F.coalesce(quality_reject(F.col("steps"), F.col("has_answer"), F.col("repetitive")), length_reject(F.col("text"), F.col("words")))


def kept(feats: DataFrame) -> DataFrame:
    return feats.where(reject_reason().isNull())
