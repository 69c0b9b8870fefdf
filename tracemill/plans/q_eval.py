"""Queries that evaluate traces and raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import text as X
from tracemill.operators import agreement, voting
from tracemill.plans.q_text import _VOTE
from tracemill.plans.views import TRACES, words_sql
from tracemill.plans.views import traces as traces_view
from tracemill.runtime import compute_once, table


def _scored(spark: SparkSession, d: str) -> DataFrame:
    t = traces_view(spark, d, once=False).select("ord", "problem_id", "is_correct", "reasoning")
    t = compute_once(t, {"words": X.words(F.col("reasoning")), "answer": A.vote_answer(F.col("reasoning"))})
    return compute_once(t, {"score": F.round(X.heuristic_score(F.col("words"), F.col("answer")), 6)}).select("ord", "problem_id", "is_correct", "answer", "score").dropDuplicates(["ord"])


def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    return voting.pass_at(traces_view(spark, d))


def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return voting.majority(voting.votes(_scored(spark, d)))


def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    return voting.weighted(voting.votes(_scored(spark, d)))


def best_of_n(spark: SparkSession, d: str) -> DataFrame:
    return voting.best_of(_scored(spark, d))


def consensus_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each trace's score with the votes and the share of its answer added."""
    t = _scored(spark, d)
    counted = voting.votes(t).select("problem_id", "answer", "n").withColumn("total", F.sum("n").over(Window.partitionBy("problem_id")))
    j = t.join(counted, ["problem_id", "answer"], "left")
    votes = F.coalesce("n", F.lit(0))
    return j.select("ord", votes.alias("votes"), F.round(F.col("score") + votes + F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)), 6).alias("score"))


def verifier_guided(spark: SparkSession, d: str) -> DataFrame:
    return voting.samples_needed(traces_view(spark, d))


def vote_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How many majority answers equal the gold number, per source; unreadable gold never does."""
    gold = A.with_number(table(spark, d, "problems").select(F.col("id").alias("problem_id"), "source_dataset", F.coalesce("answer", F.lit("")).alias("gold")), "gold", "g")
    m = voting.majority(voting.votes(_scored(spark, d))).join(gold, "problem_id")
    right = F.coalesce(F.abs(A.parse_float(F.col("answer")) - F.col("g")) < 0.001, F.lit(False))
    return m.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("problems"), F.count_if(right).alias("n_right"))


def benchmark_result(spark: SparkSession, d: str) -> DataFrame:
    """Per source: accuracy over all traces, those without a verdict counting as errors, and the run's status."""
    p = table(spark, d, "problems").select(F.col("id").alias("problem_id"), "source_dataset")
    t = table(spark, d, "reasoning_paths").dropDuplicates(["path_id"]).select("problem_id", "is_correct").join(p, "problem_id")
    r = t.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"), F.count_if(F.col("is_correct").isNull()).alias("errors"))
    status = F.when(F.col("total") == 0, "empty").when(F.col("errors") == 0, "success").when(F.col("errors") < F.col("total"), "partial").otherwise("failed")
    return r.withColumns({"accuracy": F.round(F.col("correct") / F.col("total"), 9), "status": status})


def problem_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Per source: problems in order of id, as a count and the MD5 of their ids by lines."""
    ids = F.array_join(F.array_sort(F.collect_list("id")), "\n")
    return table(spark, d, "problems").groupBy("source_dataset", "source_split").agg(F.count(F.lit(1)).alias("n"), F.md5(ids).alias("ids_md5"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "judge_verdicts").groupBy("path_id", F.lower(F.trim("judge_id")).alias("judge")).agg(F.max(F.struct("judged_at", "verdict", "reason_code")).alias("v"))
    p = table(spark, d, "problems").select(F.col("id").alias("problem_id"), X.difficulty_bin(F.col("full_solution")).alias("bin"))
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.min("problem_id").alias("problem_id"), F.first("is_correct").alias("b")).join(p, "problem_id", "left")
    return v.join(t, "path_id").select("path_id", F.col("judge").alias("pair"), agreement.verdict_of(F.col("v.verdict")).alias("a"), F.col("v.reason_code").alias("reason_code"), "b", F.coalesce("bin", F.lit("low")).alias("bin"))


def kappa_report(spark: SparkSession, d: str) -> DataFrame:
    """Each judge against the verifier, overall and by difficulty."""
    return agreement.pair_report(_judged(spark, d))


def shortcuts(spark: SparkSession, d: str) -> DataFrame:
    """Traces the verifier accepts and a judge rejects, by reason and difficulty."""
    j = _judged(spark, d).where(F.col("b") & ~F.col("a"))
    return j.groupBy(F.coalesce("reason_code", F.lit("OTHER")).alias("reason"), "bin").agg(F.count(F.lit(1)).alias("n"))


def shortcut_rate(spark: SparkSession, d: str) -> DataFrame:
    """Per judge: traces accepted by the verifier, shortcuts among them, and their share."""
    j = _judged(spark, d).where("b").groupBy(F.col("pair").alias("judge")).agg(F.count(F.lit(1)).alias("accepted"), F.count_if(~F.col("a")).alias("shortcuts"))
    return j.withColumn("rate", F.round(F.coalesce(F.try_divide("shortcuts", "accepted"), F.lit(0.0)), 9))


def panel_vote(spark: SparkSession, d: str) -> DataFrame:
    """A path's verdict by more than half of its judges, else UNCERTAIN; mean confidence of those who agree."""
    upper = F.upper(F.regexp_replace(F.coalesce("verdict", F.lit("")), "[^A-Za-z]", ""))
    kind = F.when(upper.isin("ACCEPT", "REJECT"), upper).otherwise("UNCERTAIN")
    v = table(spark, d, "judge_verdicts").groupBy("path_id", F.lower(F.trim("judge_id")).alias("judge")).agg(F.max(F.struct("judged_at", "verdict", "confidence")).alias("v")).select("path_id", F.col("v.verdict").alias("verdict"), F.col("v.confidence").alias("confidence"))
    v = v.select("path_id", kind.alias("kind"), F.coalesce(F.when(F.col("confidence") > 1, 1.0).otherwise(F.col("confidence")), F.lit(0.0)).alias("confidence"))
    kinds = ("ACCEPT", "REJECT", "UNCERTAIN")
    n = v.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds), *(F.avg(F.when(F.col("kind") == k, F.col("confidence"))).alias(f"c_{k}") for k in kinds))
    final = F.when(F.col("n_ACCEPT") * 2 > F.col("n"), "ACCEPT").when(F.col("n_REJECT") * 2 > F.col("n"), "REJECT").otherwise("UNCERTAIN")
    n = n.withColumn("verdict", final)
    sure = F.coalesce(F.when(F.col("verdict") == "ACCEPT", F.col("c_ACCEPT")).when(F.col("verdict") == "REJECT", F.col("c_REJECT")).otherwise(F.col("c_UNCERTAIN")), F.col("mean"))
    return n.select("path_id", "verdict", "n", F.round(sure, 6).alias("confidence"))


def rm_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Confidence as a score: at or above the median is true; how that agrees with the verifier."""
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.first("confidence").alias("s"), F.first("is_correct").alias("b"))
    median = t.agg(F.percentile("s", 0.5).alias("m"))
    j = t.crossJoin(F.broadcast(median)).select((F.col("s") >= F.col("m")).alias("a"), "b", "m")
    return agreement.with_kappa(j.groupBy(F.round("m", 6).alias("median")).agg(*agreement.rates()))


QUERIES = {f.__name__: f for f in (pass_at_k, majority_vote, weighted_vote, best_of_n, consensus_scores, verifier_guided, vote_accuracy, benchmark_result, problem_manifest, kappa_report, shortcuts, shortcut_rate, panel_vote, rm_threshold)}

_SCORED = f"""w0 AS MATERIALIZED (SELECT ord, problem_id, is_correct, {_VOTE} AS answer, {words_sql("reasoning")} AS w FROM traces),
scored AS MATERIALIZED (SELECT ord, problem_id, is_correct, answer, round(CASE WHEN answer IS NOT NULL THEN 0.5 ELSE 0.0 END + least(len(w) / 400.0, 0.35) - CASE WHEN len(w) < 20 THEN 0.0 ELSE greatest(0.0, 0.55 - len(list_distinct(w)) / len(w)) END, 6) AS score FROM w0),
votes AS (SELECT problem_id, answer, count(*) AS n, min(ord) AS first, sum(score) AS score FROM scored WHERE answer IS NOT NULL GROUP BY 1, 2)"""
_MAJ = "maj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY n DESC, first) AS rank, sum(n) OVER (PARTITION BY problem_id) AS total FROM votes) WHERE rank = 1)"
_BIN = "CASE WHEN coalesce((length(full_solution) - length(replace(full_solution, '<<', ''))) // 2, 0) <= 3 THEN 'low' WHEN (length(full_solution) - length(replace(full_solution, '<<', ''))) // 2 <= 6 THEN 'mid' ELSE 'high' END"
_LATEST = "latest AS (SELECT * FROM (SELECT *, lower(trim(judge_id)) AS judge, row_number() OVER (PARTITION BY path_id, lower(trim(judge_id)) ORDER BY judged_at DESC NULLS LAST, verdict DESC NULLS LAST, @tie@ DESC NULLS LAST) AS copy FROM judge_verdicts) WHERE copy = 1)"
_JUDGED = f"""{_LATEST.replace("@tie@", "reason_code")}, paths AS (SELECT path_id, min(problem_id) AS problem_id, any_value(is_correct) AS b FROM reasoning_paths GROUP BY 1),
judged AS (SELECT l.path_id, l.judge AS pair, CASE upper(regexp_replace(verdict, '[^A-Za-z]', '', 'g')) WHEN 'ACCEPT' THEN true WHEN 'REJECT' THEN false END AS a, reason_code, p.b, CASE WHEN q.id IS NULL THEN 'low' ELSE {_BIN} END AS bin FROM latest l JOIN paths p USING (path_id) LEFT JOIN problems q ON q.id = p.problem_id)"""
_RATES = "count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn, count(*) FILTER (NOT a AND NOT b) AS tn, count(*) FILTER (a IS NULL OR b IS NULL) AS dropped"
_KAPPA = """k0 AS (SELECT *, tp + fp + fn + tn AS n, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS po, (tp + fn) / nullif(tp + fp + fn + tn, 0) AS pa, (tp + fp) / nullif(tp + fp + fn + tn, 0) AS pb FROM counts), k1 AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM k0),
kappas AS (SELECT * EXCLUDE (po, pa, pb, pe), round(coalesce(po, 0.0), 9) AS agreement, round(CASE WHEN n = 0 THEN 0.0 WHEN abs(1 - pe) < 1e-12 THEN CASE WHEN abs(1 - po) < 1e-12 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END, 9) AS kappa FROM k1)"""
from tracemill.plans.q_text import _numeric  # noqa: E402

SQL = {
    "pass_at_k": f"""WITH {TRACES}, i AS (SELECT problem_id, is_correct, row_number() OVER (PARTITION BY problem_id ORDER BY ord) - 1 AS k FROM traces), f AS (SELECT problem_id, min(k) FILTER (is_correct) AS first FROM i GROUP BY 1)
        SELECT k, count(*) AS problems, count(*) FILTER (first < k) AS passed, round(count(*) FILTER (first < k) / count(*), 9) AS rate FROM f, (VALUES (1), (4), (8)) v(k) GROUP BY k""",
    "majority_vote": f"WITH {TRACES}, {_SCORED}, {_MAJ} SELECT problem_id, answer, n, round(n / total, 9) AS share, first FROM maj",
    "weighted_vote": f"WITH {TRACES}, {_SCORED} SELECT problem_id, answer, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY round(score, 6) DESC, first) AS rank FROM votes) WHERE rank = 1",
    "best_of_n": f"WITH {TRACES}, {_SCORED} SELECT problem_id, ord, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY round(score, 6) DESC, ord) AS rank FROM scored) WHERE rank = 1",
    "consensus_scores": f"WITH {TRACES}, {_SCORED}, t AS (SELECT problem_id, answer, n, sum(n) OVER (PARTITION BY problem_id) AS total FROM votes) SELECT s.ord, coalesce(n, 0) AS votes, round(s.score + coalesce(n, 0) + coalesce(n / total, 0.0), 6) AS score FROM scored s LEFT JOIN t ON t.problem_id = s.problem_id AND t.answer = s.answer",
    "verifier_guided": f"WITH {TRACES}, i AS (SELECT problem_id, is_correct, row_number() OVER (PARTITION BY problem_id ORDER BY ord) - 1 AS k FROM traces), f AS (SELECT problem_id, min(k) FILTER (is_correct) AS first FROM i WHERE k < 64 GROUP BY 1) SELECT problem_id, coalesce(CAST(ceil((first + 1) / 8) AS BIGINT) * 8, 64) AS samples, first IS NOT NULL AS solved FROM f",
    "vote_accuracy": f"WITH {TRACES}, {_SCORED}, {_MAJ}, g AS (SELECT id, source_dataset, coalesce(answer, '') AS gold FROM problems), h AS (SELECT id, source_dataset, {_numeric('gold')} AS g FROM g) SELECT source_dataset, count(*) AS problems, count(*) FILTER (abs(TRY_CAST(m.answer AS DOUBLE) - g) < 0.001) AS n_right FROM maj m JOIN h ON h.id = m.problem_id GROUP BY 1",
    "benchmark_result": """WITH t AS (SELECT path_id, min(problem_id) AS problem_id, any_value(is_correct) AS c FROM reasoning_paths GROUP BY 1), r AS (SELECT source_dataset, count(*) AS total, count(*) FILTER (c) AS correct, count(*) FILTER (c IS NULL) AS errors FROM t JOIN problems p ON p.id = t.problem_id GROUP BY 1)
        SELECT *, round(correct / total, 9) AS accuracy, CASE WHEN total = 0 THEN 'empty' WHEN errors = 0 THEN 'success' WHEN errors < total THEN 'partial' ELSE 'failed' END AS status FROM r""",
    "problem_manifest": "SELECT source_dataset, source_split, count(*) AS n, md5(string_agg(id, chr(10) ORDER BY id)) AS ids_md5 FROM problems GROUP BY 1, 2",
    "kappa_report": f"WITH {_JUDGED}, counts AS (SELECT pair, bin, {_RATES}, count(*) AS n_rows, CAST(grouping(bin) AS INT) AS overall FROM judged GROUP BY GROUPING SETS ((pair), (pair, bin))), {_KAPPA} SELECT * FROM kappas",
    "shortcuts": f"WITH {_JUDGED} SELECT coalesce(reason_code, 'OTHER') AS reason, bin, count(*) AS n FROM judged WHERE b AND NOT a GROUP BY 1, 2",
    "shortcut_rate": f"WITH {_JUDGED} SELECT pair AS judge, count(*) AS accepted, count(*) FILTER (NOT a) AS shortcuts, round(count(*) FILTER (NOT a) / count(*), 9) AS rate FROM judged WHERE b GROUP BY 1",
    "panel_vote": f"""WITH {_LATEST.replace("@tie@", "confidence")}, v AS (SELECT path_id, CASE WHEN upper(regexp_replace(coalesce(verdict, ''), '[^A-Za-z]', '', 'g')) IN ('ACCEPT', 'REJECT') THEN upper(regexp_replace(verdict, '[^A-Za-z]', '', 'g')) ELSE 'UNCERTAIN' END AS kind, coalesce(CASE WHEN confidence > 1 THEN 1.0 ELSE confidence END, 0.0) AS c FROM latest),
        n AS (SELECT path_id, count(*) AS n, avg(c) AS m, count(*) FILTER (kind = 'ACCEPT') AS na, count(*) FILTER (kind = 'REJECT') AS nr, avg(c) FILTER (kind = 'ACCEPT') AS ca, avg(c) FILTER (kind = 'REJECT') AS cr, avg(c) FILTER (kind = 'UNCERTAIN') AS cu FROM v GROUP BY 1)
        SELECT path_id, CASE WHEN na * 2 > n THEN 'ACCEPT' WHEN nr * 2 > n THEN 'REJECT' ELSE 'UNCERTAIN' END AS verdict, n, round(coalesce(CASE WHEN na * 2 > n THEN ca WHEN nr * 2 > n THEN cr ELSE cu END, m), 6) AS confidence FROM n""",
    "rm_threshold": f"WITH t AS (SELECT path_id, any_value(confidence) AS s, any_value(is_correct) AS b FROM reasoning_paths GROUP BY 1), m AS (SELECT quantile_cont(s, 0.5) AS m FROM t), j AS (SELECT s >= m AS a, b, round(m, 6) AS median FROM t, m), counts AS (SELECT median, {_RATES} FROM j GROUP BY 1), {_KAPPA} SELECT * FROM kappas",
}
