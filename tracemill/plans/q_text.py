"""Queries on single traces: tidy text, features, answers, verification, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import text as X
from tracemill.operators import preprocess
from tracemill.plans.views import BLANK, FEATURES, TRACES, normalize_sql, strip_sql, words_sql
from tracemill.plans.views import traces as traces_view
from tracemill.runtime import compute_once, table


def _once(df: DataFrame) -> DataFrame:
    """One row per trace, of a small result over rows that may be delivered twice."""
    return df.dropDuplicates(["ord"])


def _features(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.features(traces_view(spark, d, once=False), table(spark, d, "problems"))


def trace_normalize(spark: SparkSession, d: str) -> DataFrame:
    t = compute_once(traces_view(spark, d, once=False).select("ord", "reasoning"), {"text": X.normalize(F.col("reasoning"))})
    return _once(t.select("ord", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars")))


def trace_features(spark: SparkSession, d: str) -> DataFrame:
    return _once(_features(spark, d).select("ord", "steps", "has_answer", "repetitive", "n_words", "answer_key", "expected_key", "mode"))


def failure_modes(spark: SparkSession, d: str) -> DataFrame:
    f = _once(_features(spark, d).where("not is_correct").select("ord", "mode"))
    return f.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def quality_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    f = _once(_features(spark, d).select("ord", F.coalesce(preprocess.reject_reason(), F.lit("kept")).alias("reason")))
    return f.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def answer_extract(spark: SparkSession, d: str) -> DataFrame:
    t = A.with_final_answer(traces_view(spark, d, once=False).select("ord", "reasoning"), "reasoning", "answer", "marked")
    r = F.col("reasoning")
    return _once(t.select("ord", "answer", "marked", A.vote_answer(r).alias("vote"), A.last_number(r).alias("last_number")))


def verify_numeric(spark: SparkSession, d: str) -> DataFrame:
    """Status by the marked answers to a thousandth; equality and confidence of the final answers as numbers."""
    plain = lambda c, other: A.parse_float(F.replace(F.coalesce(c, other), F.lit(","), F.lit("")))
    gold = table(spark, d, "problems").select(F.col("id").alias("problem_id"), "answer", F.coalesce("answer", F.lit("")).alias("gold"))
    gold = A.with_number(A.with_final_answer(gold, "gold", "gold_answer", "gold_marked"), "answer", "g")
    gold = gold.select("problem_id", "g", plain("gold_marked", "gold").alias("gm"))
    t = traces_view(spark, d, once=False).select("ord", "problem_id", "reasoning", F.coalesce("final_answer", F.lit("")).alias("fa"))
    t = compute_once(A.with_number(A.with_final_answer(t, "reasoning", "answer", "marked"), "fa", "pf"), {"pm": plain("marked", "reasoning")})
    t = _once(t.select("ord", "problem_id", "pf", "pm")).join(gold, "problem_id")
    status = F.when(F.col("pm").isNull() | F.col("gm").isNull(), "parse_error").when(F.abs(F.col("pm") - F.col("gm")) < 0.001, "correct").otherwise("incorrect")
    equal = A.near(F.col("pf"), F.col("g"))
    sure = F.when(F.col("pf").isNull() | F.col("g").isNull(), 0.0).when(equal, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("pf") - F.col("g")) / F.greatest(F.abs("g"), F.lit(1.0))))
    return t.select("ord", status.alias("status"), equal.alias("equal"), F.round(sure, 6).alias("confidence"))


def hash_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "dpo_pairs_v1").select("provenance.pair_id", "pair.problem_id", "pair.prompt", "pair.chosen", "pair.rejected").where("pair_id is not null").distinct()
    c, r = F.col("chosen"), F.col("rejected")
    return p.select("pair_id", X.dedup_hash(c).alias("hash_chosen"), X.dedup_hash(r).alias("hash_rejected"), X.pair_id(F.col("problem_id"), c, r).alias("own_id"), X.path_hash(F.col("problem_id"), c).alias("path_hash"), X.legacy_id(F.col("prompt")).alias("legacy_id"))


def step_coherence(spark: SparkSession, d: str) -> DataFrame:
    return _once(traces_view(spark, d, once=False).select("ord", F.round(X.step_coherence(F.col("reasoning")), 6).alias("coherence")))


def step_split(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("reasoning")
    steps = X.extract_steps(r)
    return _once(traces_view(spark, d, once=False).select("ord", F.size(steps).alias("n_steps"), X.line_count(r).alias("n_lines"), F.md5(F.array_join(steps, "|")).alias("steps_md5")))


def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean of correctness, coherence and length penalty against the median length of all traces."""
    t = _once(traces_view(spark, d, once=False).select("ord", "is_correct", X.step_coherence(F.col("reasoning")).alias("coherence"), F.length("reasoning").alias("n")))
    median = _once(traces_view(spark, d, once=False).select("ord", F.length("reasoning").alias("n"))).agg(F.floor(F.percentile("n", 0.5)).alias("median"))
    score = (F.col("is_correct").cast("double") + F.col("coherence") + X.length_penalty(F.col("n"), F.col("median"))) / 3
    return t.crossJoin(F.broadcast(median)).select("ord", F.round(score, 6).alias("score"))


def difficulty_bins(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems")
    return p.groupBy(X.difficulty_bin(F.col("full_solution")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def heuristic_scores(spark: SparkSession, d: str) -> DataFrame:
    t = compute_once(traces_view(spark, d, once=False).select("ord", "reasoning"), {"words": X.words(F.col("reasoning")), "vote": A.vote_answer(F.col("reasoning"))})
    return _once(t.select("ord", F.round(X.heuristic_score(F.col("words"), F.col("vote")), 6).alias("score")))


def code_extract(spark: SparkSession, d: str) -> DataFrame:
    """The first python block, else any block, else inline code, else the whole text."""
    r = F.col("reasoning")
    block = lambda p: F.nullif(F.regexp_extract(r, p, 1), F.lit(""))
    code = X.strip(F.coalesce(block(r"(?s)```python\s*(.*?)```"), block(r"(?s)```\s*(.*?)```"), block(r"`([^`]+)`"), r))
    return _once(traces_view(spark, d, once=False).select("ord", F.md5(code).alias("code_md5")))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return _once(traces_view(spark, d, once=False).select("ord", F.md5(X.excerpt(F.col("reasoning"), 200)).alias("excerpt_md5")))


QUERIES = {
    f.__name__: f
    for f in (trace_normalize, trace_features, failure_modes, quality_filter_counts, answer_extract, verify_numeric, hash_keys, step_coherence, step_split, quality_scores, difficulty_bins, heuristic_scores, code_extract, excerpts)
}


def _artifacts(x: str) -> str:
    t = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '<\|[^>]+?\|>', ' ', 'g'), '\[/?INST\]', ' ', 'g')"
    t = rf"regexp_replace(replace({t}, '</s>', ' '), '`{{3,}}', ' ', 'g')"
    return strip_sql(f"regexp_replace({t}, '{BLANK}+', ' ', 'g')")


def _last_number(x: str) -> str:
    return rf"replace(list_last(regexp_extract_all(regexp_replace({_artifacts(x)}, '\\text\{{[^}}]*\}}', ' ', 'g'), '{A.NUMBER}')), ',', '')"


def _clean(x: str) -> str:
    edge = "' ' || chr(9) || chr(10) || chr(13) || '`*$:;,.!?\"''()[]{}'"
    c = f"trim({_artifacts(x)}, {edge})"
    c = strip_sql(rf"regexp_replace({c}, '^(?:the\s+)?(?:final\s+)?answer(?:\s+is)?[:\s-]*', '', 'i')")
    c = strip_sql(rf"regexp_replace({c}, '^#+\s*', '')")
    return rf"(SELECT CASE WHEN c = '' OR regexp_full_match(c, '[|#:\-]+') THEN NULL WHEN contains(c, '=') AND regexp_matches(c, '[a-zA-Z_]') THEN c WHEN {_last_number('c')} IS NOT NULL THEN {_last_number('c')} WHEN len(string_split(c, ' ')) > 8 THEN NULL ELSE c END FROM (SELECT CASE WHEN {x} IS NULL THEN NULL ELSE {c} END AS c))"


_PLACES = ", ".join(f"list_last(regexp_extract_all(t, '{p}', 1)) AS p{k}" for k, p in enumerate(A.ANSWER_PLACES))
_CLEANED = ", ".join(_clean(f"p{k}") for k in range(len(A.ANSWER_PLACES)))
_FINAL = f"""ext0 AS (SELECT ord, reasoning, {_artifacts("reasoning")} AS t FROM traces), ext1 AS (SELECT ord, reasoning, t, {_PLACES} FROM ext0),
ext AS (SELECT ord, reasoning, coalesce({_CLEANED}, {_last_number("t")}) AS answer FROM ext1)"""
_VOTE = r"replace(coalesce(list_last(regexp_extract_all(reasoning, '####\s*(-?[\d,]+(?:\.\d+)?)', 1)), list_last(regexp_extract_all(reasoning, '(?i)answer is[:\s]*\$?(-?[\d,]+(?:\.\d+)?)', 1))), ',', '')"
_MARKED = r"coalesce(replace(nullif(regexp_extract(reasoning, '####\s*(-?[\d,]+(?:\.\d+)?)', 1), ''), ',', ''), answer)"
_CANON = f"lower({strip_sql(f"regexp_replace(@x@, '{BLANK}+', ' ', 'g')")})"


def _canon(x: str) -> str:
    return _CANON.replace("@x@", f"coalesce({x}, '')")


_COHERENCE = rf"""(SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE avg(CASE WHEN abs(v - c) <= 1e-6 * greatest(abs(v), 1.0) THEN 1.0 ELSE 0.0 END) END FROM
    (SELECT CASE op WHEN '+' THEN a + b WHEN '-' THEN a - b WHEN '/' THEN a / nullif(b, 0) ELSE a * b END AS v, c FROM
        (SELECT CAST(unnest(regexp_extract_all(@x@, '{X.STEP}', 1)) AS DOUBLE) AS a, unnest(regexp_extract_all(@x@, '{X.STEP}', 2)) AS op, CAST(unnest(regexp_extract_all(@x@, '{X.STEP}', 3)) AS DOUBLE) AS b, CAST(unnest(regexp_extract_all(@x@, '{X.STEP}', 4)) AS DOUBLE) AS c)))"""
_STEPS = f"list_filter(list_transform(string_split(reasoning, chr(10)), lambda s: {strip_sql(f"regexp_replace(s, '{BLANK}+', ' ', 'g')")}), lambda s: length(s) >= 15)"
_PENALTY = "CASE WHEN median <= 0 OR n <= 0 OR n / median <= 2 THEN 1.0 WHEN n / median >= 6 THEN 0.0 WHEN n / median <= 4 THEN 1.0 - 0.5 * (n / median - 2.0) / 2.0 ELSE 0.5 - 0.5 * (n / median - 4.0) / 2.0 END"
_NORMAL_ANSWER = strip_sql(
    rf"trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({_artifacts('@x@')}, '[$£€]', '', 'g'), '(?i)\s*(dollars?|cents?|percent|%|miles?|hours?|minutes?|seconds?|kg|km|m|cm|mm)\s*$', ''), '\frac', ''), '(\d),(\d)', '\1\2', 'g'), '\\[a-zA-Z]+', '', 'g'), '[{{}}]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13) || '`*$:;,.!?\"''')"
)


def _float(x: str) -> str:
    return f"CASE WHEN regexp_matches({strip_sql(x)}, '{A.PLAIN_FLOAT}') THEN TRY_CAST({strip_sql(x)} AS DOUBLE) END"


def _numeric(x: str) -> str:
    n = _NORMAL_ANSWER.replace("@x@", x)
    return f"(SELECT CASE WHEN contains(n, '/') THEN CASE WHEN len(string_split(n, '/')) = 2 THEN ({_float("split_part(n, '/', 1)")}) / nullif({_float("split_part(n, '/', 2)")}, 0) END ELSE {_float('n')} END FROM (SELECT {n} AS n))"


SQL = {
    "trace_normalize": f"WITH {TRACES} SELECT ord, md5({normalize_sql('reasoning')}) AS text_md5, length({normalize_sql('reasoning')}) AS n_chars FROM traces",
    "trace_features": f"WITH {TRACES}, {FEATURES} SELECT ord, steps, has_answer, repetitive, len(words) AS n_words, answer_key, expected_key, mode FROM feat",
    "failure_modes": f"WITH {TRACES}, {FEATURES} SELECT mode, count(*) AS n FROM feat WHERE NOT is_correct GROUP BY mode",
    "quality_filter_counts": f"""WITH {TRACES}, {FEATURES} SELECT CASE WHEN steps < 2 THEN 'no_steps' WHEN NOT has_answer THEN 'no_answer' WHEN repetitive THEN 'repetitive' WHEN length(text) < 100 THEN 'too_short' WHEN length(text) > 8000 THEN 'too_long'
        WHEN len(words) < 50 THEN 'too_few_tokens' WHEN len(words) > 2048 THEN 'too_many_tokens' ELSE 'kept' END AS reason, count(*) AS n FROM feat GROUP BY 1""",
    "answer_extract": f"WITH {TRACES}, {_FINAL} SELECT ord, answer, {_MARKED} AS marked, {_VOTE} AS vote, {_last_number('reasoning')} AS last_number FROM ext",
    "verify_numeric": f"""WITH {TRACES}, {_FINAL}, ev AS (SELECT e.ord, {_MARKED.replace("answer)", "e.answer)").replace("(reasoning", "(e.reasoning")} AS marked, e.reasoning, coalesce(t.final_answer, '') AS fa, p.answer AS gold FROM ext e JOIN traces t USING (ord) JOIN problems p ON p.id = t.problem_id),
        nums AS (SELECT ord, {_float("replace(coalesce(marked, reasoning), ',', '')")} AS pm, {_numeric("fa")} AS pf, {_numeric("gold")} AS g, gold FROM ev),
        golds AS (SELECT g0.gold, {_float("replace(coalesce(e.answer, g0.gold), ',', '')")} AS gm FROM (SELECT DISTINCT coalesce(answer, '') AS gold FROM problems) g0 JOIN
            (WITH traces AS (SELECT gold AS ord, gold AS reasoning FROM (SELECT DISTINCT coalesce(answer, '') AS gold FROM problems)), {_FINAL} SELECT ord, {_MARKED} AS answer FROM ext) e ON e.ord = g0.gold)
        SELECT n.ord, CASE WHEN pm IS NULL OR gm IS NULL THEN 'parse_error' WHEN abs(pm - gm) < 0.001 THEN 'correct' ELSE 'incorrect' END AS status,
        coalesce(CASE WHEN g = 0 THEN abs(pf) < 1e-6 ELSE abs(pf - g) / abs(g) < 1e-6 END, false) AS equal,
        round(CASE WHEN pf IS NULL OR g IS NULL THEN 0.0 WHEN CASE WHEN g = 0 THEN abs(pf) < 1e-6 ELSE abs(pf - g) / abs(g) < 1e-6 END THEN 1.0 ELSE greatest(0.0, 1 - abs(pf - g) / greatest(abs(g), 1.0)) END, 6) AS confidence
        FROM nums n JOIN golds d ON d.gold = coalesce(n.gold, '')""",
    "hash_keys": f"""WITH p AS (SELECT DISTINCT provenance.pair_id AS pair_id, pair.problem_id AS problem_id, pair.prompt AS prompt, pair.chosen AS chosen, pair.rejected AS rejected FROM dpo_pairs_v1 WHERE provenance.pair_id IS NOT NULL)
        SELECT pair_id, sha256({_canon("chosen")}) AS hash_chosen, sha256({_canon("rejected")}) AS hash_rejected, sha256(coalesce(problem_id, '') || '|' || {_canon("chosen")} || '|' || {_canon("rejected")}) AS own_id,
        left(md5(coalesce(problem_id, '') || ':' || coalesce(chosen, '')), 16) AS path_hash, 'legacy_' || left(sha256(prompt), 16) AS legacy_id FROM p""",
    "step_coherence": f"WITH {TRACES} SELECT ord, round({_COHERENCE.replace('@x@', 'reasoning')}, 6) AS coherence FROM traces",
    "step_split": f"WITH {TRACES} SELECT ord, len({_STEPS}) AS n_steps, greatest(len(list_filter(string_split(reasoning, chr(10)), lambda s: {strip_sql('s')} <> '')), 1) AS n_lines, md5(array_to_string({_STEPS}, '|')) AS steps_md5 FROM traces",
    "quality_scores": f"WITH {TRACES}, m AS (SELECT floor(quantile_cont(length(reasoning), 0.5)) AS median FROM traces), t AS (SELECT ord, is_correct, reasoning, length(reasoning) AS n FROM traces) SELECT ord, round((CASE WHEN is_correct THEN 1.0 ELSE 0.0 END + {_COHERENCE.replace('@x@', 'reasoning')} + {_PENALTY}) / 3, 6) AS score FROM t, m",
    "difficulty_bins": "WITH b AS (SELECT id, coalesce((length(full_solution) - length(replace(full_solution, '<<', ''))) // 2, 0) AS s FROM problems) SELECT CASE WHEN s <= 3 THEN 'low' WHEN s <= 6 THEN 'mid' ELSE 'high' END AS bin, count(*) AS n, min(id) AS first_id FROM b GROUP BY 1",
    "heuristic_scores": f"WITH {TRACES}, w AS (SELECT ord, {_VOTE} AS vote, {words_sql('reasoning')} AS w FROM traces) SELECT ord, round(CASE WHEN vote IS NOT NULL THEN 0.5 ELSE 0.0 END + least(len(w) / 400.0, 0.35) - CASE WHEN len(w) < 20 THEN 0.0 ELSE greatest(0.0, 0.55 - len(list_distinct(w)) / len(w)) END, 6) AS score FROM w",
    "code_extract": rf"WITH {TRACES} SELECT ord, md5({strip_sql(r"coalesce(nullif(regexp_extract(reasoning, '(?s)```python\s*(.*?)```', 1), ''), nullif(regexp_extract(reasoning, '(?s)```\s*(.*?)```', 1), ''), nullif(regexp_extract(reasoning, '`([^`]+)`', 1), ''), reasoning)")}) AS code_md5 FROM traces",
    "excerpts": f"WITH {TRACES} SELECT ord, md5(CASE WHEN length(reasoning) > 200 THEN rtrim(left(reasoning, 200)) || '...' ELSE reasoning END) AS excerpt_md5 FROM traces",
}
