"""Verification of answers: text, assignments, numbers and expressions, in this order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions.symbolic import symbolic_equal
from tracemill.runtime import compute_once

# What shows that a text is reasoning rather than a bare answer, and how much a bare answer may exceed what is extracted from it.
MARKERS, SPARE = ("####", "\\boxed", "answer is", "therefore", "\n"), 8
# Rewards of each status, and their bounds.
REWARDS = {"correct": 1.0, "incorrect": 0.0, "parse_error": -0.25, "timeout": -0.25}
UNKNOWN, LEAST, MOST = -0.1, -1.0, 1.0
# Where the strict check looks for an answer; the first five count for the graded reward.
STRICT = (
    r"####\s*(-?\d+\.?\d*)", r"\\boxed\{(-?\d+\.?\d*)\}", r"the\s+(?:final\s+)?answer\s+is[:\s]+(-?\d+\.?\d*)", r"answer[:\s]+(-?\d+\.?\d*)\s*$",
    r"=\s*(-?\d+\.?\d*)\s*(?:dollars?|cents?|units?)?\s*$", r"therefore[,:\s]+.*?(-?\d+\.?\d*)\s*$", r"so[,:\s]+.*?(-?\d+\.?\d*)\s*$",
)
PLAIN = r"(-?\d+\.?\d*)"


def coerced(df: DataFrame, source: str, out: str) -> DataFrame:
    """df with the answer a text stands for: short direct answers stay whole, of reasoning only the extracted answer does."""
    df = A.with_final_answer(df, source, "_x", "_mark")
    text, x = F.col(source), F.col("_x")
    low = F.lower(text)
    marked = low.contains(MARKERS[0])
    for m in MARKERS[1:]:
        marked = marked | low.contains(m)
    value = F.when(x.isNull(), text).when(marked, x).when(F.length(text) <= F.length(x) + SPARE, text).otherwise(x)
    return compute_once(df, {out: value}).drop("_x", "_mark")


def verified(df: DataFrame, reasoning: str, gold: str) -> DataFrame:
    """df with status, by and confidence of the answer that a reasoning ends on, against a gold answer.

    A reasoning without an answer is a parse_error, whose confidence stays 1.
    Where the gold answer is a number and the other isn't, the last number of
    the answer is taken. Expressions go through Python only if nothing else
    told; by names the comparison that did. A null gold counts as empty.
    """
    df = df.withColumn("_gold", F.coalesce(F.col(gold), F.lit("")))
    df = A.with_final_answer(df, reasoning, "_f", "_mark").drop("_mark")
    df = coerced(coerced(df, "_f", "_p"), "_gold", "_g")
    df = A.with_number(A.with_number(df, "_g", "_gv"), "_p", "_pv")
    salvage = F.col("_gv").isNotNull() & F.col("_pv").isNull()
    df = compute_once(df, {"_q": F.when(salvage, F.coalesce(A.last_number(F.col("_f")), F.col("_p"))).otherwise(F.col("_p"))})
    df = A.with_number(compute_once(df, {"_pn": A.normalize_answer(F.col("_q")), "_gn": A.normalize_answer(F.col("_g"))}), "_q", "_qv")
    exact = F.lower("_pn") == F.lower("_gn")
    listed = F.col("_pn").contains("=") & F.col("_gn").contains("=") & A.assignments_equal(F.col("_pn"), F.col("_gn"))
    number = A.near(F.col("_qv"), F.col("_gv"))
    known = F.when(F.col("_f").isNull(), "none").when(exact, "text").when(listed, "assignments").when(number, "number")
    df = compute_once(df, {"_by": known})
    # Two numbers that differ, and empty answers, can't be one expression.
    open_ = F.col("_by").isNull() & ~(F.col("_qv").isNotNull() & F.col("_gv").isNotNull()) & (F.col("_pn") != "") & (F.col("_gn") != "")
    left = [F.when(F.coalesce(open_, F.lit(False)), F.col(c)) for c in ("_pn", "_gn")]
    out = df.withColumn("_by", F.coalesce("_by", F.when(symbolic_equal(*left), "expression")))
    status = F.when(F.col("_by") == "none", "parse_error").when(F.col("_by").isNotNull(), "correct").otherwise("incorrect")
    sure = F.when(F.col("_by").isNull(), 0.0).otherwise(1.0)
    return out.withColumns({"status": status, "confidence": sure, "by": F.nullif("_by", F.lit("none"))}).drop("_gold", "_f", "_p", "_g", "_gv", "_pv", "_q", "_pn", "_gn", "_qv", "_by")


def reward(status: Column) -> Column:
    """Reward of a status, clipped; anything that isn't known, null too, has UNKNOWN."""
    value = F.lit(UNKNOWN)
    for name, r in REWARDS.items():
        value = F.when(status == name, r).otherwise(value)
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), value))


def _last(text: Column, pattern: str) -> Column:
    return A.last_match(text, "(?im)" + pattern).cast("double")


def graded_reward(response: Column, gold: Column) -> Column:
    """1 for the gold number within .01 in one of the first places that give a number near it, .5 within 1, else 0; null texts count as empty."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[,$]", "")
    target = _last(bare(gold), PLAIN)
    apart = [F.abs(_last(bare(response), p) - target) for p in STRICT[:5]]
    return F.when(target.isNull(), 0.0).otherwise(F.coalesce(*(F.when(d < 0.01, 1.0).when(d < 1.0, 0.5) for d in apart), F.lit(0.0)))


def strictly_right(response: Column, gold: Column) -> Column:
    """Whether an explicit answer, or a last line with one number alone, is the gold number within .01."""
    bare = F.regexp_replace(F.coalesce(response, F.lit("")), "[,$]", "")
    target = _last(F.regexp_replace(F.coalesce(gold, F.lit("")), "[,$ ]", ""), PLAIN)
    line = F.nullif(F.regexp_extract(F.trim(F.element_at(F.split(F.btrim(bare, F.lit(" \t\r\n")), "\n"), F.lit(-1))), r"^[^\d]*(-?\d+\.?\d*)[^\d]*$", 1), F.lit("")).cast("double")
    right = F.coalesce(F.abs(line - target) < 0.01, F.lit(False))
    for p in STRICT:
        right = right | F.coalesce(F.abs(_last(bare, p) - target) < 0.01, F.lit(False))
    return F.coalesce(right, F.lit(False))


#: Verifiers by name: each adds status and confidence to rows with a text and a gold answer.
VERIFIERS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {"math": verified, "strict": lambda df, t, g: df.withColumns({"status": F.when(strictly_right(F.col(t), F.col(g)), "correct").otherwise("incorrect"), "confidence": F.lit(1.0)})}


def verifier(name: str) -> Callable[[DataFrame, str, str], DataFrame]:
    """A verifier by name in any case; ValueError for another."""
    try:
        return VERIFIERS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown verifier {name!r}; known: {', '.join(VERIFIERS)}") from None
