"""Final answers: extraction, normal form and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.functions.text import BLANK, strip
from tracemill.runtime import compute_once

# Where an answer is looked for, in order of trust.
ANSWER_PLACES = (
    r"\\boxed\{([^}]+)\}",
    r"####\s*(.+?)(?:\n|$)",
    r"[Ff]inal\s+[Aa]nswer[:\s-]*([^\n]+)",
    r"[Tt]he (?:final )?answer is[:\s]*([^\n.]+)",
    r"[Aa]nswer[:\s-]*([^\n.]+)",
    r"[Tt]herefore[,:]?\s*(?:the answer is\s*)?([^\n.]+)",
    r"=\s*([^\n=]+?)(?:\n|$)",
)
# A number with grouping, decimals or a denominator.
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?(?:/\d+(?:\.\d+)?)?"
# Units after a number, what stands around an answer, and plain numbers.
UNITS = r"(?i)\s*(dollars?|cents?|percent|%|miles?|hours?|minutes?|seconds?|kg|km|m|cm|mm)\s*$"
EDGE = " \t\n\r`*$:;,.!?\"'()[]{}"
PLAIN_FLOAT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), group), F.lit(-1))


def strip_artifacts(text: Column) -> Column:
    """Without chat tokens, frames and fences, and with single blanks."""
    # What models leave around an answer.
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|[^>]+?\|>", " ")
    t = F.regexp_replace(t, r"\[/?INST\]", " ")
    t = F.regexp_replace(F.replace(t, F.lit("</s>"), F.lit(" ")), "`{3,}", " ")
    return strip(F.regexp_replace(t, f"{BLANK}{{2,}}|[{BLANK}&&[^ ]]", " "))


def last_number(text: Column) -> Column:
    """The last number of a free text, \\text{} left out, without grouping."""
    bare = F.regexp_replace(strip_artifacts(text), r"\\text\{[^}]*\}", " ")
    return F.replace(last_match(bare, f"({NUMBER})"), F.lit(","), F.lit(""))


def normalize_answer(answer: Column) -> Column:
    """Without currency, trailing unit, grouping and LaTeX."""
    a = F.regexp_replace(strip_artifacts(answer), "[$£€]", "")
    a = F.replace(F.regexp_replace(a, UNITS, ""), F.lit("\\frac"), F.lit(""))
    a = F.regexp_replace(a, r"(\d),(\d)", "$1$2")
    a = F.regexp_replace(F.regexp_replace(a, r"\\[a-zA-Z]+", ""), "[{}]", "")
    return strip(F.btrim(a, F.lit(" \t\n\r`*$:;,.!?\"'")))


def parse_float(text: Column) -> Column:
    """Double of a plain number, else null; suffixes that only SQL casts know don't count."""
    return F.when(strip(text).rlike(PLAIN_FLOAT), strip(text).try_cast("double"))


def parse_numeric(value: Column) -> Column:
    """Number or fraction of an answer, else null."""
    n = normalize_answer(value)
    parts = F.split(n, "/")
    return F.when(n.contains("/"), F.when(F.size(parts) == 2, F.try_divide(parse_float(parts[0]), parse_float(F.try_element_at(parts, F.lit(2)))))).otherwise(parse_float(n))


def assignments(value: Column) -> Column:
    """map of x=1, y=2, or null if any part is no numeric assignment."""
    parts = F.filter(F.transform(F.split(F.btrim(normalize_answer(value), F.lit("()[]{}")), r"[,\n;]+"), strip), lambda s: s != "")
    key = lambda s: strip(F.substring_index(s, "=", 1))
    number = lambda s: parse_numeric(F.regexp_extract(s, r"=(.*)$", 1))
    fine = F.forall(parts, lambda s: key(s).rlike("^[a-zA-Z_][a-zA-Z0-9_]*$") & s.contains("=") & number(s).isNotNull())
    entries = F.array_sort(F.transform(parts, lambda s: F.struct(key(s).alias("k"), number(s).alias("v"))))
    return F.when((F.size(parts) > 0) & fine, entries)


def assignments_equal(predicted: Column, expected: Column, tolerance: float = 1e-6) -> Column:
    a, b = assignments(predicted), assignments(expected)
    same = F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: (z["a"]["k"] == z["b"]["k"]) & F.when(z["b"]["v"] == 0, F.abs(z["a"]["v"]) < tolerance).otherwise(F.abs(z["a"]["v"] - z["b"]["v"]) / F.abs(z["b"]["v"]) < tolerance))
    return F.coalesce((F.size(a) == F.size(b)) & same, F.lit(False))


def vote_answer(text: Column) -> Column:
    """The light extraction used for voting: last number after ####, else after 'answer is'."""
    number = r"(-?[\d,]+(?:\.\d+)?)"
    found = F.coalesce(last_match(text, r"####\s*" + number), last_match(text, r"(?i)answer is[:\s]*\$?" + number))
    return F.replace(found, F.lit(","), F.lit(""))


# How an answer may be introduced, and what frames a table or a heading.
INTRODUCTION, HASHES, RULE = r"(?i)^(?:the\s+)?(?:final\s+)?answer(?:\s+is)?[:\s-]*", r"^#+\s*", r"^[|#:\-]+$"


def _number_in(text: Column) -> Column:
    return F.replace(last_match(F.regexp_replace(text, r"\\text\{[^}]*\}", " "), f"({NUMBER})"), F.lit(","), F.lit(""))


def _usable(match: Column) -> Column:
    """What is left of a match without frames, edges and headings: an assignment as it is, else its last number, else up to eight words."""
    bare = strip(F.regexp_replace(F.btrim(strip(match), F.lit(EDGE)), INTRODUCTION, ""))
    bare = strip(F.regexp_replace(bare, HASHES, ""))

    def pick(b: Column) -> Column:
        short = F.when(F.size(F.split(b, " ")) <= 8, b)
        return F.when((b == "") | b.rlike(RULE), None).when(b.contains("=") & b.rlike("[a-zA-Z_]"), b).otherwise(F.coalesce(_number_in(b), short))

    return X.let(bare, pick)


def with_final_answer(df: DataFrame, source: str, answer: str, marked: str) -> DataFrame:
    """df with the answer a text column ends on, and the number after its first #### where there is one.

    The answer is the last match of the first place that gives a usable one,
    else the last number. A place is only looked at if those before gave
    nothing.
    """
    df = compute_once(df, {"_t": strip_artifacts(F.col(source))})
    found = F.coalesce(*(_usable(last_match(F.col("_t"), p)) for p in ANSWER_PLACES), _number_in(F.col("_t")))
    mark = F.replace(F.nullif(F.regexp_extract(source, r"####\s*(-?[\d,]+(?:\.\d+)?)", 1), F.lit("")), F.lit(","), F.lit(""))
    return compute_once(df, {answer: found, "_m": mark}).withColumn(marked, F.coalesce("_m", answer)).drop("_t", "_m")


def with_number(df: DataFrame, source: str, number: str) -> DataFrame:
    """df with the number an answer column stands for."""
    df = compute_once(df, {"_n": normalize_answer(F.col(source))})
    n = F.col("_n")
    parts = F.split(n, "/")
    value = F.when(n.contains("/"), F.when(F.size(parts) == 2, F.try_divide(parse_float(parts[0]), parse_float(F.try_element_at(parts, F.lit(2)))))).otherwise(parse_float(n))
    return compute_once(df, {number: value}).drop("_n")


def near(p: Column, e: Column, tolerance: float = 1e-6) -> Column:
    """Whether two numbers agree, relatively, or absolutely where the second is 0; false for null."""
    return F.coalesce(F.when(e == 0, F.abs(p) < tolerance).otherwise(F.abs(p - e) / F.abs(e) < tolerance), F.lit(False))
