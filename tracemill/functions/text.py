"""Text features of reasoning traces, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the language of the original data sees it.
BLANK = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]"
#: The same one by one, for trimming.
BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Signs of a step, counted one by one.
STEP_PATTERNS = (r"step\s*\d+", r"\d+\)", r"\d+\.", r"first|second|third|then|next|finally|therefore", r"let's|we can|we need|we have")
# Signs of an answer.
ANSWER_PATTERNS = (r"(?:the\s+)?(?:final\s+)?answer\s*(?:is|:)", r"(?:therefore|thus|so|hence)", r"=\s*[\d.]+\s*$", r"\\boxed\{", r"####")
# A number, a decimal or a fraction.
NUMBER = r"-?\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?"
# Fixed values: <<a op b = c>>.
STEP = r"<<\s*(-?\d+(?:\.\d+)?)\s*([+\-*/x×])\s*(-?\d+(?:\.\d+)?)\s*=\s*(-?\d+(?:\.\d+)?)\s*>>"
TOLERANCE = 1e-6


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, and only where the whole is asked for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Lower-cased words between white space; none for blank text, null for null."""
    return F.filter(F.split(F.lower(text), f"{BLANK}+"), lambda w: w != "")


def normalize(text: Column) -> Column:
    """Tidy a trace: blank runs, display math, role prefixes, special tokens and instruction frames, in this order."""
    t = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " ")
    t = strip(t)
    t = let(t, lambda x: F.when(x.contains("$$"), F.regexp_replace(F.regexp_replace(x, r"\$\$\s*", r"\$\$"), r"\s*\$\$", r"\$\$")).otherwise(x))
    t = F.regexp_replace(t, r"(?i)^(Assistant:|AI:|Response:)\s*", "")
    t = F.regexp_replace(t, r"<\|.*?\|>", "")
    return F.regexp_replace(t, r"(?s)\[INST\].*?\[/INST\]", "")


def step_count(text: Column) -> Column:
    """Sum of the counts of all signs of a step; overlaps count for each."""
    total = F.lit(0)
    for p in STEP_PATTERNS:
        # Alternatives are only tried where a word can begin with their first letters.
        first = "".join(sorted({a[0] for a in p.split("|")})) if "|" in p else ""
        total = total + F.regexp_count(text, F.lit(f"(?i)(?=[{first}])(?:{p})" if first else f"(?i){p}"))
    return total


def has_final_answer(text: Column) -> Column:
    found = F.lit(False)
    for p in ANSWER_PATTERNS:
        found = found | text.rlike("(?im)" + p)
    return found


def answer_key(value: Column) -> Column:
    """The last number of a value in plain form, else its bare lower-case text; null if nothing is left."""
    text = strip(value)
    last = F.try_element_at(F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(f"({NUMBER})"), 1), F.lit(-1))
    parts = F.split(last, "/")
    number = F.when(last.contains("/"), F.try_divide(parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double"))).otherwise(last.try_cast("double"))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.8f", number), "0+$", ""), r"\.$", "")
    other = F.trim(F.regexp_replace(F.lower(text), f"{BLANK}+", " "))
    other = F.nullif(F.btrim(other, F.lit(" .,!?:;`'\"")), F.lit(""))
    return F.when(text == "", None).when(last.isNull(), other).when(number.isNull(), last).otherwise(plain)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def long_sentences(text: Column) -> Column:
    """Lower-cased sentences of more than 20 characters."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda s: F.lower(strip(s))), lambda s: F.length(s) > 20)


def is_repetitive(sentences: Column, words: Column) -> Column:
    """Few distinct sentences, or few distinct runs of five words."""
    again = F.try_divide(F.size(F.array_distinct(sentences)), F.size(sentences)) < 0.7
    runs = lambda h: F.transform(F.sequence(F.lit(1), F.size(words) - 5), lambda i: F.xxhash64(F.slice(h, i, 5)))
    few = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(runs(h), lambda g: F.try_divide(F.size(F.array_distinct(g)), F.size(g)) < 0.5))
    return F.when(F.size(sentences) < 3, False).when(again, True).when(F.size(words) < 20, False).otherwise(few)


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two word sets given as distinct arrays; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def canonical(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, f"{BLANK}+", " ")))


def dedup_hash(text: Column) -> Column:
    return F.sha2(canonical(F.coalesce(text, F.lit(""))), 256)


def pair_id(problem_id: Column, chosen: Column, rejected: Column) -> Column:
    blank = F.lit("")
    return F.sha2(F.concat_ws("|", F.coalesce(problem_id, blank), canonical(F.coalesce(chosen, blank)), canonical(F.coalesce(rejected, blank))), 256)


def path_hash(problem_id: Column, text: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.coalesce(problem_id, F.lit("")), F.coalesce(text, F.lit("")))), 1, 16)


def legacy_id(prompt: Column) -> Column:
    return F.concat(F.lit("legacy_"), F.substring(F.sha2(prompt, 256), 1, 16))


def step_coherence(text: Column) -> Column:
    """Share of <<a op b = c>> blocks that hold; 1 without any. Division by zero never holds."""
    part = lambda k: F.regexp_extract_all(text, F.lit(STEP), k)

    def holds(s: Column) -> Column:
        a, b, c = (s[k].cast("double") for k in ("a", "b", "c"))
        value = F.when(s["op"] == "+", a + b).when(s["op"] == "-", a - b).when(s["op"] == "/", F.try_divide(a, b)).otherwise(a * b)
        return F.abs(value - c) <= TOLERANCE * F.greatest(F.abs(value), F.lit(1.0))

    blocks = F.arrays_zip(part(1).alias("a"), part(2).alias("op"), part(3).alias("b"), part(4).alias("c"))
    good = F.size(F.filter(blocks, lambda s: F.coalesce(holds(s), F.lit(False))))
    return F.when(text.isNull() | (F.size(blocks) <= 0), 1.0).otherwise(good / F.size(blocks))


def length_penalty(length: Column, median: Column) -> Column:
    """1 up to twice the median, then down to 0.5 at four times and 0 at six times."""
    ratio = F.try_divide(length, median)
    return F.when((median <= 0) | (length <= 0) | (ratio <= 2), 1.0).when(ratio >= 6, 0.0).when(ratio <= 4, 1.0 - 0.5 * (ratio - 2.0) / 2.0).otherwise(0.5 - 0.5 * (ratio - 4.0) / 2.0)


def extract_steps(text: Column, least: int = 15) -> Column:
    """Lines with inner white space collapsed, of at least so many characters."""
    return F.filter(F.transform(F.split(text, "\n"), lambda s: strip(F.regexp_replace(s, f"{BLANK}+", " "))), lambda s: F.length(s) >= least)


def line_count(text: Column) -> Column:
    """Lines that aren't blank, at least 1."""
    return F.greatest(F.size(F.filter(F.split(text, "\n"), lambda s: strip(s) != "")), F.lit(1))


def difficulty_bin(solution: Column) -> Column:
    steps = F.coalesce(F.regexp_count(solution, F.lit("<<")), F.lit(0))
    return F.when(steps <= 3, "low").when(steps <= 6, "mid").otherwise("high")


def heuristic_score(words: Column, key: Column) -> Column:
    """Half a point for an answer, up to .35 for length, less a penalty for repeated words."""
    n = F.size(words)
    penalty = F.when(n < 20, 0.0).otherwise(F.greatest(F.lit(0.0), 0.55 - F.size(F.array_distinct(words)) / n))
    return F.when(key.isNotNull(), 0.5).otherwise(0.0) + F.least(n / 400.0, F.lit(0.35)) - penalty


def excerpt(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("..."))).otherwise(text)
