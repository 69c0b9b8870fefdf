"""Queries on the whole chain of verification, rewards, and judges' replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import text as X
from tracemill.functions.symbolic import step_status
from tracemill.operators import agreement, verify
from tracemill.plans.q_eval import _KAPPA, _RATES
from tracemill.plans.q_text import _FINAL, _NORMAL_ANSWER, _last_number, _numeric
from tracemill.plans.views import TRACES
from tracemill.plans.views import traces as traces_view
from tracemill.runtime import compute_once, dealt, table

# Codes a judge may give for a rejection, and how long its reasons may be.
REASONS = ("INCOMPLETE_REASONING", "WRONG_METHOD", "LUCKY_GUESS", "MISSING_JUSTIFICATION", "INCONSISTENT_STEPS", "OTHER")
RATIONALE = 800
#: Letters of a response that a judge is shown, and what stands for the rest.
SHOWN, CUT = 4000, "\n[...truncated]"
#: Prompts for judges, by kind of problem, with their versions.
RUBRICS = {
    "math": ("MATH_1", "Grade this solution.\nProblem: {problem}\nSolution: {response}\nReference: {answer}\nReply with VERDICT, CONFIDENCE, REASON_CODE and RATIONALE."),
    "code": ("CODE_1", "Grade this program.\nTask: {problem}\nProgram: {response}\nExpected: {answer}\nReply with VERDICT, CONFIDENCE, REASON_CODE and RATIONALE."),
}


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "problems").select(F.col("id").alias("problem_id"), F.coalesce("answer", F.lit("")).alias("gold"))


def verify_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every trace with a known problem against its gold answer: status, what told, and confidence."""
    t = traces_view(spark, d, once=False).select("ord", "problem_id", "reasoning").join(_gold(spark, d), "problem_id")
    return verify.verified(t, "reasoning", "gold").select("ord", "status", "by", "confidence").dropDuplicates(["ord"])


def coerced_answers(spark: SparkSession, d: str) -> DataFrame:
    """The answer each final answer stands for."""
    t = traces_view(spark, d, once=False).select("ord", F.coalesce("final_answer", F.lit("")).alias("text"))
    return verify.coerced(t, "text", "answer").select("ord", "answer").dropDuplicates(["ord"])


def assignment_verify(spark: SparkSession, d: str) -> DataFrame:
    """Final and gold answers, each with a length, written as two assignments in opposite orders: equal if both parts are."""
    t = table(spark, d, "reasoning_paths").select(F.col("path_id").alias("ord"), "problem_id", "final_answer").dropDuplicates(["ord"]).join(_gold(spark, d), "problem_id")
    bare = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"^\D{0,3}(\d+(?:\.\d+)?)$", 1)
    t = compute_once(t, {"p": bare(F.col("final_answer")), "g": bare(F.col("gold"))}).where("p != '' and g != ''")
    a = F.concat(F.lit("value="), "p", F.lit(", digits="), F.length("p"))
    b = F.concat(F.lit("digits="), F.length("g"), F.lit("; value="), "g", F.lit("0").substr(F.lit(1), F.col("g").contains(".").cast("int")))
    return t.select("ord", A.assignments_equal(a, b).alias("same"))


def step_equations(spark: SparkSession, d: str) -> DataFrame:
    """The calculations of the traces, each with its status, counted by model."""
    t = table(spark, d, "reasoning_paths").select("path_id", F.col("generation_metadata.model").alias("model"), F.coalesce("reasoning", F.lit("")).alias("reasoning"))
    s = dealt(t, d, "reasoning_paths").select("path_id", "model", F.posexplode(F.regexp_extract_all("reasoning", F.lit("<<([^<>]*)>>"), F.lit(1))).alias("k", "step")).dropDuplicates(["path_id", "k"])
    return s.withColumn("status", step_status("step")).groupBy("model", "status").agg(F.count(F.lit(1)).alias("n"))


def _status(ok: Column, empty: Column, late: Column) -> Column:
    return F.when(empty, "parse_error").when(late, "timeout").when(ok.isNull(), "unknown").when(ok, "correct").otherwise("incorrect")


def status_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Rewards by status with mean and population deviation per problem: empty traces can't be parsed, those that came over a day late timed out."""
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.min("problem_id").alias("problem_id"), F.first("is_correct").alias("ok"), F.max(F.coalesce(F.length("reasoning"), F.lit(0))).alias("n"), F.min(F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("generated_at").cast("timestamp"))).alias("us"))
    r = t.select("problem_id", _status(F.col("ok"), F.col("n") == 0, F.coalesce(F.col("us") > 86_400_000_000, F.lit(False))).alias("status")).withColumn("r", verify.reward(F.col("status")))
    return r.groupBy("problem_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_pop("r"), 6).alias("std"))


def graded_rewards(spark: SparkSession, d: str) -> DataFrame:
    """The graded reward and the strict check of every trace with a known problem."""
    t = traces_view(spark, d, once=False).select("ord", "problem_id", "reasoning").join(_gold(spark, d), "problem_id")
    return t.select("ord", verify.graded_reward(F.col("reasoning"), F.col("gold")).alias("reward"), verify.strictly_right(F.col("reasoning"), F.col("gold")).alias("strict")).dropDuplicates(["ord"])


def field(reply: Column, name: str, kind: str) -> Column:
    """A field of a reply, null if it isn't there."""
    return F.nullif(F.regexp_extract(reply, rf"(?is){name}\s*[:\-]?\s*{kind}", 1), F.lit(""))


def rationale(reply: Column) -> Column:
    text = F.coalesce(F.btrim(field(reply, "RATIONALE", r"(.+?)(?:\n[A-Z_]+\s*[:\-]|\z)"), F.lit(" \t\r\n")), F.lit(""))
    return X.let(text, lambda t: F.when(F.length(t) > RATIONALE, F.concat(F.rtrim(F.substring(t, 1, RATIONALE)), F.lit("..."))).otherwise(t))


def parsed_reply(reply: Column) -> Column:
    """struct(verdict, confidence, reason, rationale) of a judge's reply.

    Without a usable verdict it is uncertain; a confidence is held between 0 and
    1; an unknown code is OTHER, and one that accepts has none; an empty or null
    reply is uncertain for OTHER.
    """
    verdict = F.upper(F.coalesce(field(reply, "VERDICT", "([A-Za-z]+)"), F.lit("")))
    verdict = F.when(verdict.isin("ACCEPT", "REJECT"), verdict).otherwise("UNCERTAIN")
    code = F.upper(F.coalesce(field(reply, "REASON_CODE", "([A-Z_]+)"), F.lit("NONE")))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(A.parse_float(field(reply, "CONFIDENCE", "([0-9.]+)")), F.lit(0.0))))
    reason = F.when(F.coalesce(reply, F.lit("")) == "", "OTHER").when(verdict == "ACCEPT", "NONE").when(code.isin("NONE", *REASONS), code).otherwise("OTHER")
    return F.struct(verdict.alias("verdict"), sure.alias("confidence"), reason.alias("reason"), F.coalesce(rationale(reply), F.lit("")).alias("rationale"))


def parsed_winner(reply: Column) -> Column:
    """struct(winner, confidence, rationale) of a pairwise reply; a tie without confidence if nothing is said."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(A.parse_float(field(reply, "CONFIDENCE", "([0-9.]+)")), F.lit(0.0))))
    return F.struct(F.upper(F.coalesce(field(reply, "WINNER", "(A|B|TIE)"), F.lit("TIE"))).alias("winner"), sure.alias("confidence"), F.coalesce(rationale(reply), F.lit("")).alias("rationale"))


def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies written out of the verdict table, with codes no judge may give among them, and parsed again."""
    v = table(spark, d, "judge_verdicts").distinct()
    code = F.when(F.col("path_id") % 11 == 0, "BAD_MOOD").otherwise(F.coalesce("reason_code", F.lit("")))
    said = F.when(F.col("path_id") % 13 == 0, F.coalesce(F.repeat(F.concat("rationale", F.lit(" ")), 20), F.lit(""))).otherwise(F.coalesce("rationale", F.lit("")))
    reply = F.when(F.col("path_id") % 17 == 0, "").otherwise(F.concat(F.lit("Verdict: "), F.coalesce("verdict", F.lit("")), F.lit("\nconfidence - "), F.coalesce(F.round("confidence", 2).cast("string"), F.lit("")), F.lit("\nREASON_CODE: "), code, F.lit("\nRATIONALE: "), said, F.lit("\nNOTES: none")))
    r = v.select("path_id", "judge_id", "judged_at", X.let(reply, parsed_reply).alias("r"))
    return r.groupBy("r.verdict", "r.reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r.confidence"), 4).alias("confidence"), F.sum(F.length("r.rationale")).alias("n_chars"))


def pairwise_replies(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise replies written out of the scores of pairs, and parsed again."""
    s = table(spark, d, "sample_pairs").select("pair_id", "scored_at", "diversity_score", "chosen_answer").distinct()
    winner = F.when(F.isnan("diversity_score") | F.col("diversity_score").isNull(), "").when(F.col("diversity_score") > 0.6, "winner: a").when(F.col("diversity_score") < 0.4, "WINNER B").otherwise("WINNER - tie")
    reply = F.concat(winner, F.lit("\nCONFIDENCE: "), F.coalesce(F.round(F.col("diversity_score") * 2, 3).cast("string"), F.lit("?")), F.lit("\nRATIONALE: "), F.coalesce("chosen_answer", F.lit("")))
    r = s.select("pair_id", X.let(reply, parsed_winner).alias("r"))
    return r.groupBy("r.winner").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r.confidence"), 4).alias("confidence"), F.sum(F.length("r.rationale")).alias("n_chars"))


def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt that shows a judge each trace with a known problem: the rubric of its kind, the response clipped."""
    p = table(spark, d, "problems").select(F.col("id").alias("problem_id"), F.coalesce("problem", F.lit("")).alias("q"), F.coalesce("answer", F.lit("(not provided)")).alias("gold"), F.when(F.col("entry_point").isNotNull(), "code").otherwise("math").alias("kind"))
    t = traces_view(spark, d, once=False).select("ord", "problem_id", F.when(F.length("reasoning") > SHOWN, F.concat(F.substring("reasoning", 1, SHOWN), F.lit(CUT))).otherwise(F.col("reasoning")).alias("shown")).join(p, "problem_id")
    out = None
    for kind, (version, rubric) in RUBRICS.items():
        parts = [F.col({"problem": "q", "response": "shown", "answer": "gold"}[x[1:-1]]) if x.startswith("{") else F.lit(x) for x in _pieces(rubric)]
        made = F.struct(F.lit(version).alias("version"), F.concat(*parts).alias("prompt"))
        out = F.when(F.col("kind") == kind, made) if out is None else out.when(F.col("kind") == kind, made)
    return t.select("ord", out.alias("p")).select("ord", "p.version", F.md5("p.prompt").alias("prompt_md5"), F.length("p.prompt").alias("n_chars")).dropDuplicates(["ord"])


def _pieces(rubric: str) -> list[str]:
    return [x for x in re.split(r"(\{\w+\})", rubric) if x]


def panel_full(spark: SparkSession, d: str) -> DataFrame:
    """A path's verdict by its panel under each policy for splits, with the most confident member that agrees as its voice.

    Of one judge's verdicts on a path the latest counts. A verdict needs more
    than half; a split goes by the policy. If nobody agrees with the outcome the
    confidence is the mean of all and the reason is OTHER for a rejection.
    """
    judge = F.lower(F.trim("judge_id"))
    last = F.max(F.struct("judged_at", "verdict", "confidence", "reason_code", "rationale"))
    v = table(spark, d, "judge_verdicts").groupBy("path_id", judge.alias("judge")).agg(last.alias("v"))
    ok = agreement.verdict_of(F.col("v.verdict"))
    kind = F.when(ok, "ACCEPT").when(~ok, "REJECT").otherwise("UNCERTAIN")
    sure = F.coalesce(F.least(F.lit(1.0), "v.confidence"), F.lit(0.0))
    v = v.select("path_id", "judge", kind.alias("kind"), sure.alias("c"), F.col("v.reason_code").alias("code"), F.coalesce("v.rationale", F.lit("")).alias("said"))
    kinds = ("ACCEPT", "REJECT", "UNCERTAIN")
    of = lambda k: F.when(F.col("kind") == k, F.col("c"))
    voice = lambda k: F.min_by(F.struct("judge", "code", F.md5("said").alias("said")), F.when(F.col("kind") == k, F.struct(-F.col("c"), "judge")))
    g = v.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean"), *(F.count(of(k)).alias(f"n_{k}") for k in kinds), *(F.avg(of(k)).alias(f"c_{k}") for k in kinds), *(voice(k).alias(f"v_{k}") for k in kinds))
    g = g.crossJoin(F.broadcast(v.sparkSession.createDataFrame([("uncertain",), ("reject",), ("accept",)], "policy string")))
    final = F.when(F.col("n_ACCEPT") * 2 > F.col("n"), "ACCEPT").when(F.col("n_REJECT") * 2 > F.col("n"), "REJECT").when(F.col("n_UNCERTAIN") * 2 > F.col("n"), "UNCERTAIN").otherwise(F.upper("policy"))
    g = g.withColumn("verdict", final)
    pick = lambda prefix: F.when(F.col("verdict") == "ACCEPT", F.col(f"{prefix}_ACCEPT")).when(F.col("verdict") == "REJECT", F.col(f"{prefix}_REJECT")).otherwise(F.col(f"{prefix}_UNCERTAIN"))
    g = g.withColumns({"k": pick("n"), "c": pick("c"), "v": pick("v")})
    reason = F.when(F.col("k") > 0, F.col("v.code")).when(F.col("verdict") == "REJECT", "OTHER").otherwise("NONE")
    return g.select("path_id", "policy", "verdict", F.round(F.coalesce("c", "mean"), 6).alias("confidence"), reason.alias("reason"), F.when(F.col("k") > 0, F.col("v.judge")).alias("voice"))


def length_bias(spark: SparkSession, d: str) -> DataFrame:
    """Per judge: problems where it accepts the longest wrong trace it saw and rejects the shortest right one, of those where it saw both kinds."""
    v = table(spark, d, "judge_verdicts").groupBy("path_id", F.lower(F.trim("judge_id")).alias("judge")).agg(F.max(F.struct("judged_at", "verdict"))["verdict"].alias("verdict"))
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.min("problem_id").alias("problem_id"), F.first("is_correct").alias("ok"), F.max(F.coalesce(F.length("reasoning"), F.lit(0))).alias("n")).where("ok is not null")
    j = v.join(t, "path_id").withColumn("a", agreement.verdict_of(F.col("verdict"))).where("judge is not null")
    g = j.groupBy("judge", "problem_id").agg(F.max_by("a", F.when(~F.col("ok"), F.struct("n", "path_id"))).alias("long_wrong"), F.min_by("a", F.when(F.col("ok"), F.struct("n", "path_id"))).alias("short_right"), F.count_if("ok").alias("r"), F.count_if(~F.col("ok")).alias("w")).where("r > 0 and w > 0")
    found = F.coalesce(F.col("long_wrong") & ~F.col("short_right"), F.lit(False))
    return g.groupBy("judge").agg(F.count(F.lit(1)).alias("problems"), F.count_if("long_wrong").alias("long_wrong_accepted"), F.count_if(~F.col("short_right")).alias("short_right_rejected"), F.count_if(found).alias("detected"))


def rater_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Verifier, panel and the model's own confidence (sure from .5 on) as raters of every judged trace, compared in pairs."""
    panel = panel_full(spark, d).where("policy = 'uncertain'").select("path_id", agreement.verdict_of(F.col("verdict")).alias("panel"))
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.first("is_correct").alias("verifier"), (F.first("confidence") >= 0.5).alias("model")).join(panel, "path_id")
    pairs = F.array(*(F.struct(F.lit(f"{x} {y}").alias("pair"), F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("verifier", "panel"), ("verifier", "model"), ("panel", "model"))))
    return agreement.with_kappa(t.select(F.inline(pairs)).groupBy("pair").agg(*agreement.rates()))


def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts and confidences of each path as parallel lists in order of time, put together by place; lists of different lengths raise."""
    v = table(spark, d, "judge_verdicts").distinct()
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("judged_at", "judge_id", F.coalesce("verdict", F.lit("")).alias("verdict"), F.coalesce("confidence", F.lit(-1.0)).alias("confidence")))), lambda s: s[c])
    g = v.groupBy("path_id").agg(ordered("verdict").alias("a"), ordered("confidence").alias("b"))
    return zip_strict(g, "a", "b").groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == "").alias("empty"), F.round(F.sum("b"), 4).alias("confidence"))


def zip_strict(df: DataFrame, a: str, b: str) -> DataFrame:
    """A row per place of two lists of one length, with their values; lists of different lengths raise an error."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit(f"{a} and {b} differ in length"))
    return df.where(same.isNull()).select(*(c for c in df.columns if c not in (a, b)), F.posexplode(F.arrays_zip(a, b)).alias("place", "_z")).select("*", f"_z.{a}", f"_z.{b}").drop("_z")


def test_programs(spark: SparkSession, d: str) -> DataFrame:
    """Programs of the code problems: the code of their solution and, if there are any, their tests."""
    p = table(spark, d, "problems").where("entry_point is not null")
    code, tests = F.rtrim(F.coalesce("full_solution", F.lit(""))), F.trim(F.coalesce("test", F.lit("")))
    program = F.concat(code, F.when(tests != "", F.concat(F.lit("\n\n# --- injected tests ---\n"), tests)).otherwise(""), F.lit("\n"))
    return p.select("id", F.md5(program).alias("program_md5"), F.length(program).alias("n_chars"))


QUERIES = {f.__name__: f for f in (verify_chain, coerced_answers, assignment_verify, step_equations, status_rewards, graded_rewards, judge_replies, pairwise_replies, judge_prompts, panel_full, length_bias, rater_pairs, positional_zip, test_programs)}


def _ext(source: str) -> str:
    """Extracted answers (ord, answer) of a query that gives ord and reasoning."""
    return f"(WITH traces AS ({source}), {_FINAL} SELECT ord, answer FROM ext)"


_MARKED = " OR ".join(f"contains(lower(t), {m})" for m in ("'####'", "'\\boxed'", "'answer is'", "'therefore'", "chr(10)"))
_COERCED = f"CASE WHEN x IS NULL THEN t WHEN {_MARKED} THEN x WHEN length(t) <= length(x) + 8 THEN t ELSE x END"
_N = lambda c: _NORMAL_ANSWER.replace("@x@", c)
_V = "v AS (SELECT path_id, lower(trim(judge_id)) AS judge, judged_at, verdict, confidence, reason_code, rationale, row_number() OVER (PARTITION BY path_id, lower(trim(judge_id)) ORDER BY judged_at DESC NULLS LAST, verdict DESC NULLS LAST, confidence DESC NULLS LAST, reason_code DESC NULLS LAST, rationale DESC NULLS LAST) AS k FROM judge_verdicts)"
_KIND = "CASE upper(regexp_replace(verdict, '[^A-Za-z]', '', 'g')) WHEN 'ACCEPT' THEN 'ACCEPT' WHEN 'REJECT' THEN 'REJECT' ELSE 'UNCERTAIN' END"
_PANEL = f"""{_V}, m AS (SELECT path_id, judge, {_KIND} AS kind, coalesce(least(1.0, confidence), 0.0) AS c, reason_code AS code FROM v WHERE k = 1),
c AS (SELECT path_id, count(*) AS n, avg(c) AS mean, count(*) FILTER (kind = 'ACCEPT') AS na, count(*) FILTER (kind = 'REJECT') AS nr, count(*) FILTER (kind = 'UNCERTAIN') AS nu FROM m GROUP BY 1),
f AS (SELECT *, CASE WHEN na * 2 > n THEN 'ACCEPT' WHEN nr * 2 > n THEN 'REJECT' WHEN nu * 2 > n THEN 'UNCERTAIN' ELSE upper(policy) END AS verdict FROM c, (VALUES ('uncertain'), ('reject'), ('accept')) p(policy)),
s AS (SELECT path_id, kind, avg(c) AS c, first(code ORDER BY c DESC, judge NULLS FIRST) AS code, first(judge ORDER BY c DESC, judge NULLS FIRST) AS voice FROM m GROUP BY 1, 2),
panel AS (SELECT f.path_id, policy, f.verdict, round(coalesce(s.c, mean), 6) AS confidence, CASE WHEN s.kind IS NOT NULL THEN s.code WHEN f.verdict = 'REJECT' THEN 'OTHER' ELSE 'NONE' END AS reason, s.voice FROM f LEFT JOIN s ON s.path_id = f.path_id AND s.kind = f.verdict)"""
_STRICT = [p.replace("'", "''") for p in verify.STRICT]
_LAST = lambda t, p: f"TRY_CAST(list_last(regexp_extract_all({t}, '(?im){p}', 1)) AS DOUBLE)"
_REPLY = r"""CASE WHEN path_id % 17 = 0 THEN '' ELSE 'Verdict: ' || coalesce(verdict, '') || chr(10) || 'confidence - ' || coalesce(CAST(round(confidence, 2) AS VARCHAR), '') || chr(10) || 'REASON_CODE: ' || CASE WHEN path_id % 11 = 0 THEN 'BAD_MOOD' ELSE coalesce(reason_code, '') END
    || chr(10) || 'RATIONALE: ' || coalesce(CASE WHEN path_id % 13 = 0 THEN repeat(rationale || ' ', 20) ELSE coalesce(rationale, '') END, '') || chr(10) || 'NOTES: none' END"""
SQL = {
    "verify_chain": f"""WITH {TRACES}, g AS (SELECT t.ord, t.reasoning, coalesce(p.answer, '') AS gold FROM traces t JOIN problems p ON p.id = t.problem_id),
        f AS (SELECT g.ord, gold, e.answer AS f FROM g JOIN {_ext("SELECT ord, reasoning FROM g")} e USING (ord)),
        p AS (SELECT f.ord, gold, f, e.answer AS x, f AS t FROM f LEFT JOIN {_ext("SELECT ord, f AS reasoning FROM f WHERE f IS NOT NULL")} e USING (ord)),
        golds AS (SELECT t AS gold, {_COERCED} AS gc FROM (SELECT e.ord AS t, e.answer AS x FROM {_ext("SELECT DISTINCT gold AS ord, gold AS reasoning FROM g")} e)),
        c AS MATERIALIZED (SELECT ord, f, {_COERCED} AS pc, gc FROM p JOIN golds USING (gold)),
        n AS MATERIALIZED (SELECT *, {_numeric("gc")} AS gv, {_numeric("pc")} AS pv FROM c),
        q AS MATERIALIZED (SELECT ord, f, gv, gc, CASE WHEN gv IS NOT NULL AND pv IS NULL THEN coalesce({_last_number("f")}, pc) ELSE pc END AS q FROM n),
        r AS (SELECT ord, f, lower({_N("q")}) = lower({_N("gc")}) AS same, coalesce(CASE WHEN gv = 0 THEN abs(qv) < 1e-6 ELSE abs(qv - gv) / abs(gv) < 1e-6 END, false) AS near FROM (SELECT *, {_numeric("q")} AS qv FROM q))
        SELECT ord, CASE WHEN f IS NULL THEN 'parse_error' WHEN same OR near THEN 'correct' ELSE 'incorrect' END AS status, CASE WHEN f IS NULL THEN NULL WHEN same THEN 'text' WHEN near THEN 'number' END AS by, CASE WHEN f IS NULL OR same OR near THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM r""",
    "coerced_answers": f"WITH {TRACES}, s AS (SELECT ord, coalesce(final_answer, '') AS t FROM traces) SELECT ord, {_COERCED} AS answer FROM (SELECT s.ord, t, e.answer AS x FROM s JOIN {_ext('SELECT ord, t AS reasoning FROM s')} e USING (ord))",
    "assignment_verify": r"""WITH t AS (SELECT path_id AS ord, regexp_extract(coalesce(any_value(final_answer), ''), '^\D{0,3}(\d+(?:\.\d+)?)$', 1) AS p, min(problem_id) AS problem_id FROM reasoning_paths GROUP BY 1), j AS (SELECT ord, p, regexp_extract(coalesce(q.answer, ''), '^\D{0,3}(\d+(?:\.\d+)?)$', 1) AS g FROM t JOIN problems q ON q.id = t.problem_id)
        SELECT ord, length(p) = length(g) AND CASE WHEN CAST(g AS DOUBLE) = 0 THEN CAST(p AS DOUBLE) < 1e-6 ELSE abs(CAST(p AS DOUBLE) - CAST(g AS DOUBLE)) / CAST(g AS DOUBLE) < 1e-6 END AS same FROM j WHERE p <> '' AND g <> ''""",
    "step_equations": r"""WITH t AS (SELECT path_id, min(generation_metadata.model) AS model, coalesce(any_value(reasoning), '') AS r FROM reasoning_paths GROUP BY 1), s AS (SELECT model, unnest(regexp_extract_all(r, '<<([^<>]*)>>', 1)) AS s FROM t),
        e AS (SELECT model, s, length(s) - length(replace(s, '=', '')) AS n, regexp_matches(s, '^\s*-?[\d.]+\s*[-+*/]\s*-?[\d.]+\s*=\s*-?[\d.]+\s*$') AS plain, TRY_CAST(regexp_extract(s, '^\s*(-?[\d.]+)\s*([-+*/])\s*(-?[\d.]+)\s*=\s*(-?[\d.]+)\s*$', 1) AS DECIMAL(30, 6)) AS a, regexp_extract(s, '^\s*-?[\d.]+\s*([-+*/])', 1) AS op, TRY_CAST(regexp_extract(s, '^\s*(-?[\d.]+)\s*([-+*/])\s*(-?[\d.]+)\s*=', 3) AS DECIMAL(30, 6)) AS b, TRY_CAST(regexp_extract(s, '=\s*(-?[\d.]+)\s*$', 1) AS DECIMAL(30, 6)) AS c FROM s)
        SELECT model, CASE WHEN n = 0 THEN 'unknown' WHEN n > 1 OR NOT plain THEN 'parse_error' WHEN CASE op WHEN '+' THEN a + b = c WHEN '-' THEN a - b = c WHEN '*' THEN a * b = c ELSE b <> 0 AND c * b = a END THEN 'correct' ELSE 'incorrect' END AS status, count(*) AS n FROM e GROUP BY 1, 2""",
    "status_rewards": """WITH t AS (SELECT path_id, min(problem_id) AS problem_id, any_value(is_correct) AS ok, max(coalesce(length(reasoning), 0)) AS n, min(epoch_us(ingested_at) - epoch_us(generated_at)) AS us FROM reasoning_paths GROUP BY 1),
        r AS (SELECT problem_id, CASE WHEN n = 0 THEN -0.25 WHEN us > 86400000000 THEN -0.25 WHEN ok IS NULL THEN -0.1 WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE AS r FROM t) SELECT problem_id, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std FROM r GROUP BY 1""",
    "graded_rewards": f"""WITH {TRACES}, j AS MATERIALIZED (SELECT ord, regexp_replace(reasoning, '[,$]', '', 'g') AS r, {_LAST("regexp_replace(coalesce(answer, ''), '[,$]', '', 'g')", "(-?[0-9]+[.]?[0-9]*)")} AS g FROM traces JOIN problems p ON p.id = problem_id),
        k AS (SELECT ord, g, {", ".join(f"abs({_LAST('r', p)} - g) AS d{i}" for i, p in enumerate(_STRICT))}, abs(TRY_CAST(nullif(regexp_extract(trim(list_last(string_split(trim(r, ' ' || chr(9) || chr(10) || chr(13)), chr(10)))), '^[^\\d]*(-?\\d+\\.?\\d*)[^\\d]*$', 1), '') AS DOUBLE) - g) AS d FROM j)
        SELECT ord, CASE WHEN g IS NULL THEN 0.0 ELSE coalesce({", ".join(f"CASE WHEN d{i} < 0.01 THEN 1.0 WHEN d{i} < 1.0 THEN 0.5 END" for i in range(5))}, 0.0) END::DOUBLE AS reward, coalesce({" OR ".join(f"coalesce(d{i} < 0.01, false)" for i in range(7))} OR coalesce(d < 0.01, false), false) AS strict FROM k""",
    "judge_replies": f"""WITH r AS (SELECT {_REPLY} AS reply FROM (SELECT DISTINCT * FROM judge_verdicts)), e AS (SELECT reply, upper(regexp_extract(reply, '(?is)VERDICT\\s*[:\\-]?\\s*([A-Za-z]+)', 1)) AS v, regexp_extract(reply, '(?is)CONFIDENCE\\s*[:\\-]?\\s*([0-9.]+)', 1) AS c, upper(regexp_extract(reply, '(?is)REASON_CODE\\s*[:\\-]?\\s*([A-Z_]+)', 1)) AS k, trim(regexp_extract(reply, '(?is)RATIONALE\\s*[:\\-]?\\s*(.+?)(?:\\n[A-Z_]+\\s*[:\\-]|\\z)', 1), ' ' || chr(9) || chr(10) || chr(13)) AS said FROM r),
        f AS (SELECT CASE WHEN v IN ('ACCEPT', 'REJECT') THEN v ELSE 'UNCERTAIN' END AS verdict, greatest(0.0, least(1.0, coalesce(TRY_CAST(nullif(c, '') AS DOUBLE), 0.0))) AS c, CASE WHEN reply = '' THEN 'OTHER' WHEN v = 'ACCEPT' THEN 'NONE' WHEN k IN ('', 'NONE') THEN 'NONE' WHEN k IN {REASONS} THEN k ELSE 'OTHER' END AS reason, CASE WHEN length(said) > 800 THEN rtrim(left(said, 800)) || '...' ELSE said END AS said FROM e)
        SELECT verdict, reason, count(*) AS n, round(sum(c), 4) AS confidence, CAST(sum(length(said)) AS BIGINT) AS n_chars FROM f GROUP BY 1, 2""",
    "pairwise_replies": """WITH s AS (SELECT DISTINCT pair_id, scored_at, diversity_score AS v, chosen_answer AS a FROM sample_pairs), r AS (SELECT CASE WHEN isnan(v) OR v IS NULL THEN 'TIE' WHEN v > 0.6 THEN 'A' WHEN v < 0.4 THEN 'B' ELSE 'TIE' END AS winner, CASE WHEN v IS NULL OR isnan(v) THEN 0.0 ELSE greatest(0.0, least(1.0, round(v * 2, 3))) END AS c, trim(coalesce(a, '')) AS said FROM s)
        SELECT winner, count(*) AS n, round(sum(c), 4) AS confidence, CAST(sum(length(said)) AS BIGINT) AS n_chars FROM r GROUP BY 1""",
    "judge_prompts": f"""WITH {TRACES}, j AS (SELECT ord, CASE WHEN length(reasoning) > 4000 THEN left(reasoning, 4000) || chr(10) || '[...truncated]' ELSE reasoning END AS r, coalesce(p.problem, '') AS q, coalesce(answer, '(not provided)') AS g, entry_point IS NOT NULL AS code FROM traces t JOIN problems p ON p.id = t.problem_id),
        m AS (SELECT ord, CASE WHEN code THEN 'CODE_1' ELSE 'MATH_1' END AS version, CASE WHEN code THEN 'Grade this program.' || chr(10) || 'Task: ' || q || chr(10) || 'Program: ' || r || chr(10) || 'Expected: ' || g ELSE 'Grade this solution.' || chr(10) || 'Problem: ' || q || chr(10) || 'Solution: ' || r || chr(10) || 'Reference: ' || g END || chr(10) || 'Reply with VERDICT, CONFIDENCE, REASON_CODE and RATIONALE.' AS p FROM j)
        SELECT ord, version, md5(p) AS prompt_md5, length(p) AS n_chars FROM m""",
    "panel_full": f"WITH {_PANEL} SELECT * FROM panel",
    "length_bias": f"""WITH {_V}, m AS (SELECT path_id, judge, nullif({_KIND}, 'UNCERTAIN') = 'ACCEPT' AS a FROM v WHERE k = 1 AND judge IS NOT NULL), t AS (SELECT path_id, min(problem_id) AS problem_id, any_value(is_correct) AS ok, max(coalesce(length(reasoning), 0)) AS n FROM reasoning_paths GROUP BY 1),
        j AS (SELECT *, row_number() OVER (PARTITION BY judge, problem_id, ok ORDER BY CASE WHEN ok THEN n ELSE -n END, CASE WHEN ok THEN path_id ELSE -path_id END) AS k FROM m JOIN t USING (path_id) WHERE ok IS NOT NULL),
        g AS (SELECT judge, problem_id, bool_or(a) FILTER (k = 1 AND NOT ok) AS lw, bool_or(a) FILTER (k = 1 AND ok) AS sr FROM j GROUP BY 1, 2 HAVING count(*) FILTER (ok) > 0 AND count(*) FILTER (NOT ok) > 0)
        SELECT judge, count(*) AS problems, count(*) FILTER (lw) AS long_wrong_accepted, count(*) FILTER (NOT sr) AS short_right_rejected, count(*) FILTER (lw AND NOT sr) AS detected FROM g GROUP BY 1""",
    "rater_pairs": f"""WITH {_PANEL}, t AS (SELECT path_id, any_value(is_correct) AS verifier, any_value(confidence) >= 0.5 AS model FROM reasoning_paths GROUP BY 1), j AS (SELECT verifier, model, CASE verdict WHEN 'ACCEPT' THEN true WHEN 'REJECT' THEN false END AS panel FROM t JOIN panel USING (path_id) WHERE policy = 'uncertain'),
        w AS (SELECT 'verifier panel' AS pair, verifier AS a, panel AS b FROM j UNION ALL SELECT 'verifier model', verifier, model FROM j UNION ALL SELECT 'panel model', panel, model FROM j), counts AS (SELECT pair, {_RATES} FROM w GROUP BY 1), {_KAPPA} SELECT * FROM kappas""",
    "positional_zip": "WITH v AS (SELECT DISTINCT * FROM judge_verdicts), o AS (SELECT path_id, coalesce(verdict, '') AS a, coalesce(confidence, -1.0) AS b, row_number() OVER (PARTITION BY path_id ORDER BY judged_at NULLS FIRST, judge_id NULLS FIRST, coalesce(verdict, ''), coalesce(confidence, -1.0)) - 1 AS place FROM v) SELECT CAST(place AS INT) AS place, count(*) AS n, count(*) FILTER (a = '') AS empty, round(sum(b), 4) AS confidence FROM o GROUP BY 1",
    "test_programs": "WITH p AS (SELECT id, rtrim(coalesce(full_solution, '')) || CASE WHEN trim(coalesce(test, '')) <> '' THEN chr(10) || chr(10) || '# --- injected tests ---' || chr(10) || trim(test) ELSE '' END || chr(10) AS p FROM problems WHERE entry_point IS NOT NULL) SELECT id, md5(p) AS program_md5, length(p) AS n_chars FROM p",
}
