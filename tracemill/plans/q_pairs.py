"""Queries on preference pairs and their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators import pairs, preprocess
from tracemill.plans.views import FEATURES, TRACES, words_sql
from tracemill.plans.views import traces as traces_view
from tracemill.runtime import table


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.kept(preprocess.features(traces_view(spark, d, once=False), table(spark, d, "problems")))


def pairs_smart(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: filtered traces, paired, scored, and reduced to the best five pairs of a problem."""
    return pairs.smart_pairs(_kept(spark, d))


def pair_rejects(spark: SparkSession, d: str) -> DataFrame:
    return pairs.judged_pairs(_kept(spark, d)).groupBy(F.coalesce("reject", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def pair_summary(spark: SparkSession, d: str) -> DataFrame:
    p = pairs_smart(spark, d)
    return p.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("diversity"), 5).alias("mean_diversity"), F.round(F.avg("quality"), 5).alias("mean_quality"))


def pair_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of the problems with traces that have a smart pair."""
    have = pairs_smart(spark, d).select("problem_id").distinct().withColumn("hit", F.lit(1))
    all_ = traces_view(spark, d).select("problem_id").distinct()
    counted = all_.join(have, "problem_id", "left").agg(F.count(F.lit(1)).alias("problems"), F.count("hit").alias("covered"))
    return counted.withColumn("coverage", F.round(F.coalesce(F.try_divide("covered", "problems"), F.lit(0.0)), 6))


def pairs_naive(spark: SparkSession, d: str) -> DataFrame:
    """Per problem: diverse pairs and their mean diversity."""
    p = pairs.diverse_pairs(traces_view(spark, d, once=False))
    return p.groupBy("problem_id").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("diversity")) / F.sum("n"), 5).alias("mean_diversity"), F.round(F.max("diversity"), 6).alias("most"))


def pairs_first(spark: SparkSession, d: str) -> DataFrame:
    return pairs.first_pairs(traces_view(spark, d))


def pairs_v1(spark: SparkSession, d: str) -> DataFrame:
    return pairs.ordered_pairs(traces_view(spark, d))


def pair_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each pair_id by time of generation, with its provenance flat."""
    p = table(spark, d, "dpo_pairs_v1").select("provenance.*")
    first = F.row_number().over(Window.partitionBy("pair_id").orderBy("generated_at"))
    return p.withColumn("k", first).where("k = 1").select("pair_id", "problem_id", "source_dataset", "source_split", "generator_model", "schema_version", F.round("quality_score", 6).alias("quality_score"))


def dpo_records(spark: SparkSession, d: str) -> DataFrame:
    """Records with all of prompt, chosen and rejected, alias fields filled in."""
    p = table(spark, d, "dpo_pairs_v1").select("pair.*", "provenance.pair_id").distinct()
    prompt = X.first_filled(F.col("prompt"), F.col("problem"))
    expected = X.first_filled(F.col("expected_answer"), F.col("chosen_answer"))
    return p.select("pair_id", F.md5(prompt).alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"), expected.alias("expected")).where("prompt_md5 is not null and chosen_md5 is not null and rejected_md5 is not null")


def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Problems that have no pair yet."""
    done = table(spark, d, "dpo_pairs_v1").select(F.lower(F.trim("pair.problem_id")).alias("id"))
    return table(spark, d, "problems").join(done, "id", "left_anti").select("id", "source_dataset")


def run_stats(spark: SparkSession, d: str) -> DataFrame:
    """Traces, accepted ones and the accept rate per backend, and in all."""
    t = traces_view(spark, d).rollup("backend").agg(F.grouping("backend").cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("accepted"))
    return t.withColumn("accept_rate", F.round(F.col("accepted") / F.col("n"), 9))


def pair_quality_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the table with their provenance, latest diversity score and the quality kept in either place."""
    p = table(spark, d, "dpo_pairs_v1").select(F.col("provenance.pair_id").alias("pair_id"), F.col("provenance.quality_score").alias("q1"), F.col("quality_score").alias("q2")).distinct()
    s = table(spark, d, "sample_pairs").groupBy("pair_id").agg(F.max("diversity_score").alias("best"), F.count(F.lit(1)).alias("scores"))
    return p.join(s, "pair_id", "left").select("pair_id", F.round(F.coalesce("q1", "q2"), 6).alias("quality"), F.round(F.when(~F.isnan("best"), F.col("best")), 6).alias("best"), F.coalesce("scores", F.lit(0)).alias("scores"))


QUERIES = {f.__name__: f for f in (pairs_smart, pair_rejects, pair_summary, pair_coverage, pairs_naive, pairs_first, pairs_v1, pair_dedup, dpo_records, resume_antijoin, run_stats, pair_quality_scores)}

_KEPT = "kept AS (SELECT *, list_distinct(words) AS wset, md5(text) AS tk FROM feat WHERE NOT (steps < 2 OR NOT has_answer OR repetitive OR length(text) < 100 OR length(text) > 8000 OR len(words) < 50 OR len(words) > 2048))"
_JACCARD = "CASE WHEN len(@a@) = 0 OR len(@b@) = 0 THEN 0.0 ELSE len(list_intersect(@a@, @b@)) / (len(@a@) + len(@b@) - len(list_intersect(@a@, @b@))) END"


def _jac(a: str, b: str) -> str:
    return _JACCARD.replace("@a@", a).replace("@b@", b)


_BONUS = "CASE r.mode " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.BONUS.items()) + " ELSE 0.0 END"
_JUDGED = f"""j0 AS MATERIALIZED (SELECT c.problem_id, c.ord AS co, r.ord AS ro, c.confidence AS cc, r.confidence AS rc, c.steps AS cs, r.steps AS rs, c.answer_key AS ca, r.answer_key AS ra, c.tk, r.mode, r.has_answer AS rh, {_BONUS} AS bonus,
    floor((1 - {_jac("c.wset", "r.wset")}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS diversity FROM kept c JOIN kept r ON c.problem_id = r.problem_id AND c.is_correct AND NOT r.is_correct AND c.confidence >= 0.5),
j1 AS (SELECT *, floor((0.38::DOUBLE * diversity + 0.22::DOUBLE * greatest(0.0::DOUBLE, cc - rc) + 0.14::DOUBLE * (least(rs, cs) / greatest(cs, 1)) + 0.10::DOUBLE * CASE WHEN ra <> ca THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN rh THEN 0.08::DOUBLE ELSE -0.08::DOUBLE END + bonus::DOUBLE + 0.12::DOUBLE * least(rc, 0.75::DOUBLE)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS quality FROM j0),
judged AS (SELECT *, CASE WHEN diversity < 0.2 THEN 'low_diversity' WHEN ca = ra THEN 'same_answer' WHEN cs > 0 AND rs / greatest(cs, 1) < 0.5 AND mode IN ('trivial_short', 'missing_final_answer', 'repetitive') THEN 'unstructured_negative' WHEN quality < 0.05 THEN 'low_quality' END AS reject FROM j1)"""
_BEST = "ORDER BY quality DESC, diversity DESC, cc DESC, co, rc DESC, ro"
_SMART = f"""s1 AS (SELECT *, row_number() OVER (PARTITION BY problem_id, mode {_BEST}) AS k1 FROM judged WHERE reject IS NULL), s2 AS (SELECT *, row_number() OVER (PARTITION BY problem_id, tk {_BEST}) AS k2 FROM s1 WHERE k1 <= 2),
s3 AS (SELECT *, row_number() OVER (PARTITION BY problem_id {_BEST}) AS k FROM s2 WHERE k2 <= 2), smart AS (SELECT problem_id, co AS chosen, ro AS rejected, mode AS error_type, diversity, quality, k AS rank FROM s3 WHERE k <= 5)"""
_ALL = f"WITH {TRACES}, {FEATURES}, {_KEPT}, {_JUDGED}, {_SMART}"
_SETS = f"sets AS MATERIALIZED (SELECT ord, problem_id, is_correct, list_distinct({words_sql('reasoning')}) AS s FROM traces)"
_CANON = r"lower(regexp_replace(regexp_replace(@x@, '[\s\p{Z}\x{85}\x0b\x1c-\x1f]+', ' ', 'g'), '^[\s\p{Z}\x{85}\x0b\x1c-\x1f]+|[\s\p{Z}\x{85}\x0b\x1c-\x1f]+$', '', 'g'))"
SQL = {
    "pairs_smart": f"{_ALL} SELECT * FROM smart",
    "pair_rejects": f"{_ALL} SELECT coalesce(reject, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "pair_summary": f"{_ALL} SELECT error_type, count(*) AS n, round(avg(diversity), 5) AS mean_diversity, round(avg(quality), 5) AS mean_quality FROM smart GROUP BY 1",
    "pair_coverage": f"{_ALL} SELECT count(*) AS problems, count(s.problem_id) AS covered, round(count(s.problem_id) / count(*), 6) AS coverage FROM (SELECT DISTINCT problem_id FROM traces) t LEFT JOIN (SELECT DISTINCT problem_id FROM smart) s ON s.problem_id IS NOT DISTINCT FROM t.problem_id",
    "pairs_naive": f"""WITH {TRACES}, {_SETS}, p AS (SELECT c.problem_id, CASE WHEN len(c.s) = 0 OR len(r.s) = 0 THEN 0.0 ELSE 1 - {_jac("c.s", "r.s")} END AS dv FROM sets c JOIN sets r ON c.problem_id = r.problem_id AND c.is_correct AND NOT r.is_correct)
        SELECT problem_id, count(*) AS n, round(avg(dv), 5) AS mean_diversity, round(max(dv), 6) AS most FROM p WHERE dv >= 0.1 GROUP BY 1""",
    "pairs_first": f"WITH {TRACES}, k AS (SELECT *, row_number() OVER (PARTITION BY problem_id, is_correct ORDER BY ord) AS k FROM traces) SELECT c.problem_id, c.ord AS chosen, r.ord AS rejected FROM k c JOIN k r ON c.problem_id = r.problem_id AND c.is_correct AND NOT r.is_correct AND c.k <= 2 AND r.k <= 2",
    "pairs_v1": f"""WITH {TRACES}, h AS MATERIALIZED (SELECT ord, problem_id, is_correct, {_CANON.replace("@x@", "reasoning")} AS canon FROM traces),
        p AS (SELECT c.problem_id, c.ord AS co, r.ord AS ro, sha256(coalesce(c.problem_id, '') || '|' || c.canon || '|' || r.canon) AS pair_id FROM h c JOIN h r ON c.problem_id = r.problem_id AND c.is_correct AND NOT r.is_correct),
        o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY co, ro) AS k FROM p), q AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY co, ro) AS m FROM o WHERE k = 1)
        SELECT problem_id, co AS chosen, ro AS rejected, pair_id FROM q WHERE m <= 3""",
    "pair_dedup": "SELECT pair_id, problem_id, source_dataset, source_split, generator_model, schema_version, round(quality_score, 6) AS quality_score FROM (SELECT provenance.*, row_number() OVER (PARTITION BY provenance.pair_id ORDER BY provenance.generated_at) AS k FROM dpo_pairs_v1) WHERE k = 1",
    "dpo_records": """WITH p AS (SELECT DISTINCT pair, provenance.pair_id AS pair_id FROM dpo_pairs_v1), r AS (SELECT pair_id, md5(coalesce(nullif(pair.prompt, ''), nullif(pair.problem, ''))) AS prompt_md5, md5(pair.chosen) AS chosen_md5, md5(pair.rejected) AS rejected_md5,
        coalesce(nullif(pair.expected_answer, ''), nullif(pair.chosen_answer, '')) AS expected FROM p) SELECT * FROM r WHERE prompt_md5 IS NOT NULL AND chosen_md5 IS NOT NULL AND rejected_md5 IS NOT NULL""",
    "resume_antijoin": "SELECT id, source_dataset FROM problems p WHERE NOT EXISTS (SELECT 1 FROM dpo_pairs_v1 d WHERE lower(trim(d.pair.problem_id)) = p.id)",
    "run_stats": f"WITH {TRACES} SELECT backend, CAST(grouping(backend) AS INT) AS is_total, count(*) AS n, count(*) FILTER (is_correct) AS accepted, round(count(*) FILTER (is_correct) / count(*), 9) AS accept_rate FROM traces GROUP BY ROLLUP (backend)",
    "pair_quality_scores": """WITH p AS (SELECT DISTINCT provenance.pair_id AS pair_id, provenance.quality_score AS q1, quality_score AS q2 FROM dpo_pairs_v1), s AS (SELECT pair_id, max(diversity_score) AS best, count(*) AS scores FROM sample_pairs GROUP BY 1)
        SELECT p.pair_id, round(coalesce(q1, q2), 6) AS quality, round(CASE WHEN NOT isnan(best) THEN best END, 6) AS best, coalesce(scores, 0) AS scores FROM p LEFT JOIN s USING (pair_id)""",
}
