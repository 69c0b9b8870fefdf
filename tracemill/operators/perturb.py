"""Perturbations of problem texts, as Catalyst expressions; draws come from a hash of id, name and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.answers import parse_float
from tracemill.functions.text import let, strip
from tracemill.runtime import compute_once

# Unit words, what they become, and the factor.
UNITS = (("dollars|dollar", "cents", 100.0), ("hours|hour", "minutes", 60.0), ("kilograms|kilogram", "grams", 1000.0), ("kg|kg", "g", 1000.0))
# Words that refer back.
PRONOUNS = r"(?i)\b(he|she|it|they|him|her|them|his|hers|its|their|theirs|that|those|this|these)\b"
# Numbers that a distracting sentence may hold.
DISTRACTING = (7, 11, 13, 17, 19, 23)
ASIDES = (
    "Rain is expected over the hills tonight.", "The ferry leaves from the northern pier.", "A violin was playing two streets away.", "The orchard wall was painted last spring.", "Nobody had closed the garden gate.",
    "The clock in the hall runs slightly fast.", "Somebody left a green scarf on the bench.", "The post is usually late on Fridays.", "A heron stood by the pond all morning.", "The lighthouse has been empty for years.",
    "Lavender grows along the railway line.", "The baker whistles when the oven is hot.", "An umbrella was forgotten in the tram.", "The choir practises in the old granary.", "Fog often hides the lower valley.",
    "The mayor collects maps of small islands.", "Two kites were caught in the poplar.", "The well behind the inn has run dry.", "A blue door opens onto the courtyard.", "The harvest festival was moved to Sunday.",
)
DISTRACTORS = (
    "The hill behind the mill has {} steps.", "Someone counted {} swans on the lake.", "The old theatre has {} doors.", "A map on the wall shows {} villages.", "The choir owns {} candlesticks.", "On the pier {} boats were waiting.", "The tower clock has been repaired {} times.",
)


def draw(key: Column, name: str, n: Column | int, seed: int = 0) -> Column:
    """A number from 0 to n - 1, from the first eight digits of the MD5 of key, name and seed."""
    digits = F.substring(F.md5(F.concat_ws(":", key, F.lit(name), F.lit(str(seed)))), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % (n if isinstance(n, Column) else F.lit(n))).cast("int")


def scaled(value: Column) -> Column:
    """A number in plain form: whole if it is whole, else up to six decimals."""
    return F.when(F.abs(value - F.round(value)) < 1e-9, F.round(value).cast("long").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", ""))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), r"(?<=[.!?])\s+(?=[A-Z0-9])"), strip), lambda s: s != "")


def unit_change(text: Column, answer: Column) -> Column:
    """struct(text, answer, applicable, reason): the first known unit rewritten, the answer scaled."""
    number = parse_float(answer)
    out = F.struct(text.alias("text"), F.lit(None).cast("string").alias("answer"), F.lit(False).alias("applicable"), F.lit("no_recognized_unit").alias("reason"))
    for words, unit, factor in reversed(UNITS):
        pattern = rf"(?i)\b({words})\b"
        hit = F.struct(F.regexp_replace(text, pattern, unit).alias("text"), scaled(number * factor).alias("answer"), F.lit(True).alias("applicable"), F.lit(None).cast("string").alias("reason"))
        out = F.when(text.rlike(pattern), hit).otherwise(out)
    return F.when(number.isNull(), F.struct(text.alias("text"), F.lit(None).cast("string").alias("answer"), F.lit(False).alias("applicable"), F.lit("non_numeric_answer").alias("reason"))).otherwise(out)


def reordering(parts: Column, text: Column) -> Column:
    """struct(text, applicable, reason): the first two sentences swapped unless they depend on each other."""
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    reason = F.when(F.size(parts) < 3, "too_few_sentences").when(first.rlike(PRONOUNS), "pronoun_in_s1").when(F.regexp_extract(second, r"^\W*(\w+)", 1).rlike(PRONOUNS), "pronoun_at_s2_start")
    swapped = F.array_join(F.concat(F.array(second, first), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))), " ")
    return F.struct(F.when(reason.isNull(), swapped).otherwise(text).alias("text"), reason.isNull().alias("applicable"), reason.alias("reason"))


def aside(key: Column, text: Column, seed: int = 0) -> Column:
    """An unrelated sentence put before the text."""
    return F.concat(F.element_at(F.array(*map(F.lit, ASIDES)), draw(key, "aside", len(ASIDES), seed) + 1), F.lit(" "), F.ltrim(text))


def distractor(key: Column, parts: Column, text: Column, answer: Column, seed: int = 0) -> Column:
    """A sentence with a number that isn't the answer, after the first sentence or at the end of a short text."""
    number = parse_float(answer)
    pool = F.filter(F.array(*map(F.lit, DISTRACTING)), lambda n: number.isNull() | (F.abs(n - number) > 1e-9))
    pick = F.element_at(pool, draw(key, "number", F.size(pool), seed) + 1)
    said = F.replace(F.element_at(F.array(*map(F.lit, DISTRACTORS)), draw(key, "distractor", len(DISTRACTORS), seed) + 1), F.lit("{}"), pick.cast("string"))
    many = F.array_join(F.concat(F.slice(parts, 1, 1), F.array(said), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))), " ")
    return F.when(F.size(parts) >= 2, many).otherwise(F.concat(F.rtrim(text), F.lit(" "), said))


def paraphrases(text: Column) -> Column:
    """All texts that one rule gives and that differ from the text."""
    low = F.lower(text)
    once = lambda pattern, new: F.concat(F.regexp_extract(text, rf"(?is)^(.*?){pattern}", 1), F.lit(new), F.regexp_extract(text, rf"(?is)^.*?{pattern}(.*)$", 1))
    so = r"(?s)([A-Z])([^.!?]*?),\s+so\s+([a-z])(.*)$"
    # What each rule looks for and what it puts there.
    rules = [
        F.when(low.contains(" and then "), once(r"\s+and then\s+", "; after that ")),
        F.when(text.rlike(so), F.concat(F.lit("Because "), F.lower(F.regexp_extract(text, so, 1)), F.regexp_extract(text, so, 2), F.lit(", "), F.upper(F.regexp_extract(text, so, 3)), F.regexp_extract(text, so, 4))),
        F.when(low.contains(" after "), once(r"\bafter\b", "following")),
        F.when(text.rlike(r"(?i)\bbuys\b") & ~F.regexp_extract(text, r"(?is)^(.*?)\bbuys\b", 1).rlike(r"(?i)\bbuy\b"), once(r"\bbuys\b", "purchases")).when(text.rlike(r"(?i)\bbuy\b"), once(r"\bbuy\b", "purchase")),
        F.when(low.contains(" each "), once(r"\beach\b", "per item")),
        F.when(text.rlike(r"(?i)\bin total\b"), once(r"\bin total\b", "altogether")),
    ]
    return F.filter(F.array(*rules), lambda r: r.isNotNull() & (r != text))


def number_swap(key: Column, text: Column, answer: Column, solution: Column, seed: int = 0) -> Column:
    """struct(applicable, reason, operand, answer): the last step's factor that the text holds once is drawn anew, the answer scaled."""
    step = F.try_element_at(F.regexp_extract_all(solution, F.lit(r"<<([^<>=]+)=([^<>]+)>>"), 1), F.lit(-1))
    result = strip(F.try_element_at(F.regexp_extract_all(solution, F.lit(r"<<([^<>=]+)=([^<>]+)>>"), 2), F.lit(-1)))
    a, r = parse_float(answer), parse_float(result)
    product = r"^\s*(-?\d+(?:\.\d+)?)\s*\*\s*(-?\d+(?:\.\d+)?)\s*$"
    factors = F.array(F.regexp_extract(step, product, 1), F.regexp_extract(step, product, 2))
    places = lambda f: F.size(F.split(text, F.concat(F.lit(r"(?<![\w.])-?\Q"), F.ltrim(f, F.lit("-")), F.lit(r"\E(?![\w.])")))) - 1
    fits = lambda f: let(parse_float(f), lambda v: (v != 0) & (F.abs(v - a) >= 1e-9)) & (places(f) == 1)

    def swapped(s: Column) -> Column:
        """The swap for s, a struct of the safe factors and the reason not to swap."""
        pick = F.try_element_at(s["safe"], draw(key, "factor", F.greatest(F.size(s["safe"]), F.lit(1)), seed) + 1)
        return let(F.struct(pick.alias("pick"), parse_float(pick).alias("old"), s["reason"].alias("reason")), drawn)

    def drawn(p: Column) -> Column:
        low, high = F.greatest(F.lit(1), F.round(p["old"] / 2)).cast("long"), F.greatest(F.lit(2), F.round(p["old"] * 2)).cast("long")
        return let(F.struct(p["pick"].alias("pick"), p["old"].alias("old"), p["reason"].alias("reason"), low.alias("low"), high.alias("high"), (low + draw(key, "value", (high - low + 1).cast("long"), seed)).alias("new")), made)

    def made(p: Column) -> Column:
        new = F.when(p["new"] == p["old"], F.when(p["old"] < p["high"], p["high"]).otherwise(p["low"])).otherwise(p["new"])
        ok = p["reason"].isNull()
        return F.struct(ok.alias("applicable"), p["reason"].alias("reason"), F.when(ok, p["pick"]).alias("operand"), F.when(ok, new.cast("string")).alias("new_operand"), F.when(ok, scaled(a * new / p["old"])).alias("answer"))

    def reasoned(safe: Column) -> Column:
        reason = (
            F.when(solution.isNull() | (solution == ""), "no_solution").when(step.isNull(), "no_step_markers").when(a.isNull() | r.isNull(), "non_numeric_answer").when(F.abs(a - r) > 1e-6, "answer_neq_final_step")
            .when(~step.rlike(product), "non_multiplicative_final").when(F.size(safe) == 0, "no_safe_operand")
        )
        return let(F.struct(safe.alias("safe"), reason.alias("reason")), swapped)

    return let(F.filter(factors, fits), reasoned)


#: The perturbations in canonical order, and whether they change the label.
REGISTRY = {"number_swap": True, "unit_change": True, "irrelevant_context": False, "distractor_sentence": False, "paraphrase": False, "reordering": False}


def apply_all(problems: DataFrame, seed: int = 0) -> DataFrame:
    """A row for every problem (id, problem, answer, full_solution) and perturbation: change, rewrites, applicable, reason, text and answer.

    Where a perturbation doesn't apply the text stays; where it keeps the label
    the answer is that of the problem. Null texts count as empty.
    """
    text, answer, key = F.col("problem"), F.col("answer"), F.col("id")
    p = problems.select("id", F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("answer", F.lit("")).alias("answer"), "full_solution")
    p = compute_once(p, {"parts": sentences(text)})
    p = compute_once(p, {"swap": number_swap(key, text, answer, F.col("full_solution"), seed), "unit": unit_change(text, answer), "order": reordering(F.col("parts"), text), "rules": paraphrases(text)})
    rule = F.try_element_at(F.col("rules"), draw(key, "rule", F.greatest(F.size("rules"), F.lit(1)), seed) + 1)
    swapped = F.regexp_replace(text, F.concat(F.lit(r"(?<![\w.])-?\Q"), F.ltrim(F.col("swap.operand"), F.lit("-")), F.lit(r"\E(?![\w.])")), F.col("swap.new_operand"))
    none = F.lit(None).cast("string")

    def outcome(name: str, applicable: Column, reason: Column, new: Column, label: Column) -> Column:
        return F.struct(F.lit(name).alias("change"), F.lit(REGISTRY[name]).alias("rewrites"), applicable.alias("applicable"), reason.alias("reason"), F.when(applicable, new).otherwise(text).alias("text"), F.coalesce(F.when(applicable, label), answer).alias("new_answer"))

    out = [
        outcome("number_swap", F.col("swap.applicable"), F.col("swap.reason"), swapped, F.col("swap.answer")), outcome("unit_change", F.col("unit.applicable"), F.col("unit.reason"), F.col("unit.text"), F.col("unit.answer")),
        outcome("irrelevant_context", F.lit(True), none, aside(key, text, seed), none), outcome("distractor_sentence", F.lit(True), none, distractor(key, F.col("parts"), text, answer, seed), none),
        outcome("paraphrase", F.size("rules") > 0, F.when(F.size("rules") == 0, "no_rule"), rule, none), outcome("reordering", F.col("order.applicable"), F.col("order.reason"), F.col("order.text"), none),
    ]
    return p.select("id", F.inline(F.array(*out)))
