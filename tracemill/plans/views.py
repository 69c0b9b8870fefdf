"""The views that queries share, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.runtime import dealt, table


def traces(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """One row per trace: ord, problem_id, reasoning, final_answer, is_correct, confidence, backend, model.

    Rows delivered twice have the same content. Without once they stay, for
    queries that drop them from a small result rather than shuffle the texts.
    """
    paths = table(spark, sf_dir, "reasoning_paths")
    paths = paths.dropDuplicates(["path_id"]) if once else dealt(paths, sf_dir, "reasoning_paths")
    return paths.select(
        F.col("path_id").alias("ord"), "problem_id", "problem", F.coalesce("reasoning", F.lit("")).alias("reasoning"), "final_answer", F.coalesce("is_correct", F.lit(False)).alias("is_correct"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("generation_metadata.backend").alias("backend"), F.col("generation_metadata.model").alias("model"),
    )


TRACES = """traces AS (SELECT path_id AS ord, problem_id, problem, coalesce(reasoning, '') AS reasoning, final_answer, coalesce(is_correct, false) AS is_correct, coalesce(confidence, 0.0) AS confidence,
    generation_metadata.backend AS backend, generation_metadata.model AS model FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY ingested_at) AS copy FROM reasoning_paths) WHERE copy = 1)"""

BLANK = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def words_sql(x: str) -> str:
    """Words as a list; one empty word for blank text is filtered out."""
    return f"list_filter(regexp_split_to_array({strip_sql(f'lower({x})')}, '{BLANK}+'), lambda w: w <> '')"


def normalize_sql(x: str) -> str:
    t = strip_sql(rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g')")
    t = rf"regexp_replace(regexp_replace({t}, '\$\$\s*', '$$', 'g'), '\s*\$\$', '$$', 'g')"
    t = rf"regexp_replace({t}, '^(Assistant:|AI:|Response:)\s*', '', 'i')"
    t = rf"regexp_replace({t}, '<\|.*?\|>', '', 'g')"
    return rf"regexp_replace({t}, '(?s)\[INST\].*?\[/INST\]', '', 'g')"


def count_sql(x: str, pattern: str, options: str = "i") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}', 0, '{options}'))"


def step_count_sql(x: str) -> str:
    # Fixed values, written out apart from those of the engine, so that a wrong one shows.
    signs = (r"step\s*\d+", r"\d+\)", r"\d+\.", "first|second|third|then|next|finally|therefore", "let''s|we can|we need|we have")
    return "(" + " + ".join(count_sql(x, p) for p in signs) + ")"


def has_answer_sql(x: str) -> str:
    signs = (r"(?:the\s+)?(?:final\s+)?answer\s*(?:is|:)", "(?:therefore|thus|so|hence)", r"=\s*[\d.]+\s*$", r"\\boxed\{", "####")
    return "(" + " OR ".join(f"regexp_matches({x}, '(?im){p}')" for p in signs) + ")"


def answer_key_sql(x: str) -> str:
    t = strip_sql(x)
    last = rf"list_last(regexp_extract_all(replace({t}, ',', ''), '-?\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?'))"
    number = f"CASE WHEN contains({last}, '/') THEN TRY_CAST(split_part({last}, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part({last}, '/', 2) AS DOUBLE), 0) ELSE TRY_CAST({last} AS DOUBLE) END"
    plain = rf"regexp_replace(regexp_replace(format('{{:.8f}}', {number}), '0+$', ''), '\.$', '')"
    other = f"nullif(trim(trim(regexp_replace(lower({t}), '{BLANK}+', ' ', 'g')), ' .,!?:;`''\"'), '')"
    return f"CASE WHEN {t} = '' THEN NULL WHEN {last} IS NULL THEN {other} WHEN ({number}) IS NULL THEN {last} ELSE {plain} END"


#: Features of each trace, as features() gives them.
FEATURES = rf"""feat0 AS MATERIALIZED (SELECT ord, problem_id, is_correct, confidence, final_answer, {normalize_sql("reasoning")} AS text FROM traces),
feat1 AS MATERIALIZED (SELECT f.*, {step_count_sql("text")} AS steps, {has_answer_sql("text")} AS has_answer, {words_sql("text")} AS words,
    list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda s: lower({strip_sql("s")})), lambda s: length(s) > 20) AS sentences,
    coalesce(nullif(final_answer, ''), text) AS key_source, p.answer AS gold FROM feat0 f LEFT JOIN problems p ON p.id = f.problem_id),
feat2 AS MATERIALIZED (SELECT * EXCLUDE (sentences, key_source, gold), {answer_key_sql("key_source")} AS answer_key, {answer_key_sql("gold")} AS expected_key,
    CASE WHEN len(sentences) < 3 THEN false WHEN len(list_distinct(sentences)) / len(sentences) < 0.7 THEN true WHEN len(words) < 20 THEN false
    ELSE len(list_distinct(list_transform(range(1, len(words) - 4), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')))) / (len(words) - 5) < 0.5 END AS repetitive FROM feat1),
feat AS (SELECT *, CASE WHEN len(words) < 12 THEN 'trivial_short' WHEN NOT has_answer THEN 'missing_final_answer' WHEN repetitive THEN 'repetitive' WHEN answer_key <> expected_key THEN 'answer_mismatch'
    WHEN answer_key IS NULL THEN 'parse_like_failure' ELSE 'reasoning_gap' END AS mode FROM feat2)"""
