"""Queries on perturbed problems and what stays solved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import agreement, perturb, robustness
from tracemill.plans.q_text import _float
from tracemill.plans.views import strip_sql
from tracemill.runtime import compute_once, table


def _problems(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "problems").select("id", F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("answer", F.lit("")).alias("answer"), "full_solution")
    return compute_once(p, {"parts": perturb.sentences(F.col("problem"))})


def unit_change(spark: SparkSession, d: str) -> DataFrame:
    p = _problems(spark, d).withColumn("out", perturb.unit_change(F.col("problem"), F.col("answer")))
    return p.select("id", F.md5("out.text").alias("text_md5"), F.col("out.answer").alias("new_answer"), "out.applicable", "out.reason")


def reordering(spark: SparkSession, d: str) -> DataFrame:
    p = _problems(spark, d).withColumn("out", perturb.reordering(F.col("parts"), F.col("problem")))
    return p.select("id", F.md5("out.text").alias("text_md5"), "out.applicable", "out.reason", F.size("parts").alias("n_sentences"))


def number_swap(spark: SparkSession, d: str) -> DataFrame:
    p = _problems(spark, d).withColumn("out", perturb.number_swap(F.col("id"), F.col("problem"), F.col("answer"), F.col("full_solution")))
    return p.select("id", "out.applicable", "out.reason", "out.operand", "out.new_operand", F.col("out.answer").alias("new_answer"))


def label_preserving(spark: SparkSession, d: str) -> DataFrame:
    """Each problem with an aside, with a distractor, and paraphrased where a rule fits."""
    p = _problems(spark, d)
    key, text = F.col("id"), F.col("problem")
    p = compute_once(p, {"rules": perturb.paraphrases(text), "aside": perturb.aside(key, text), "distractor": perturb.distractor(key, F.col("parts"), text, F.col("answer"))})
    picked = F.try_element_at(F.col("rules"), perturb.draw(key, "rule", F.greatest(F.size("rules"), F.lit(1))) + 1)
    return p.select("id", "aside", "distractor", picked.alias("paraphrase"), F.size("rules").alias("n_rules"))


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.min("problem_id").alias("problem_id"), F.first("is_correct").alias("ok"), F.min("generation_metadata.model").alias("change"))
    base = t.groupBy("problem_id").agg(robustness.vote(F.col("ok")).alias("before"))
    after = t.where("change is not null").groupBy("change", "problem_id").agg(robustness.vote(F.col("ok")).alias("after"))

    return after.join(base, "problem_id").withColumn("applicable", F.lit(True))


def perturbation_stats(spark: SparkSession, d: str) -> DataFrame:
    """Each model as a change: problems that all traces solve by majority, and those that its own solve."""
    return robustness.retention(_outcomes(spark, d))


def robustness_geomean(spark: SparkSession, d: str) -> DataFrame:
    r = perturbation_stats(spark, d)
    return r.agg(F.count(F.lit(1)).alias("changes"), F.round(robustness.geometric_mean(F.col("retention")), 6).alias("geomean"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("group", *(F.round(c, 6).alias(c) for c in ("value", "low", "high")))


def bootstrap_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per model with a bootstrap interval."""
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.min("generation_metadata.model").alias("model"), F.first("is_correct").alias("ok")).where("ok is not null")
    return _rounded(robustness.bootstrap_metric(t, "path_id", "model", {"k": F.col("ok").cast("int"), "n": F.lit(1)}, F.try_divide("k", "n")))


def bootstrap_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Each judge's kappa against the verifier, with an interval over resampled traces."""
    v = table(spark, d, "judge_verdicts").groupBy("path_id", F.lower(F.trim("judge_id")).alias("judge")).agg(F.max(F.struct("judged_at", "verdict"))["verdict"].alias("verdict"))
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.first("is_correct").alias("b"))
    j = v.join(t, "path_id").withColumn("a", agreement.verdict_of(F.col("verdict")))
    a, b = F.col("a"), F.col("b")
    return _rounded(robustness.bootstrap_metric(j, "path_id", "judge", {"tp": (a & b).cast("int"), "fp": (~a & b).cast("int"), "fn": (a & ~b).cast("int"), "tn": (~a & ~b).cast("int")}, robustness.kappa()))


def seed_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Mean, sample deviation and interval over seeds of each model's mean quality and mean temperature; a metric that a seed lacks is left out."""
    p = table(spark, d, "dpo_pairs_v1").select(F.col("provenance.generator_model").alias("model"), (F.col("provenance.generation_seed") % 5).alias("seed"), F.expr("inline(array(struct('quality' AS metric, quality_score AS v), struct('temperature' AS metric, provenance.generation_temperature AS v)))")).where("model is not null and seed is not null")
    seeds = p.groupBy("model").agg(F.count_distinct("seed").alias("n_seeds"))
    m = p.where("v is not null").groupBy("model", "metric", "seed").agg(F.round(F.avg("v"), 6).alias("m"))
    m = m.join(m.groupBy("model", "metric").agg(F.count(F.lit(1)).alias("n")).join(seeds, "model").where("n = n_seeds").select("model", "metric", "n"), ["model", "metric"]).withColumn("group", F.concat_ws(" ", "model", "metric"))
    ci = robustness.bootstrap_metric(m, "seed", "group", {"s": F.col("m"), "c": F.lit(1)}, F.try_divide("s", "c"))
    std = m.groupBy("group").agg(F.first("n").alias("n"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 5).alias("std"))
    return ci.join(std, "group").select("group", "n", "std", *(F.round(c, 5).alias(c) for c in ("value", "low", "high")))


def perturbed(spark: SparkSession, d: str) -> DataFrame:
    """What every perturbation makes of every problem."""
    return perturb.apply_all(table(spark, d, "problems")).select("id", "change", "rewrites", "applicable", "reason", "new_answer", F.md5("text").alias("text_md5"))


def _run(spark: SparkSession, d: str) -> DataFrame:
    """Every problem under every perturbation: before, by a vote over its traces, and after, by a stand-in that fails a fifth of what was solved."""
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.min("problem_id").alias("id"), F.first("is_correct").alias("ok"))
    base = t.groupBy("id").agg(robustness.vote(F.col("ok")).alias("before"))
    p = perturb.apply_all(table(spark, d, "problems")).select("id", "change", "applicable", "reason")
    after = F.col("before") & (perturb.draw(F.col("id"), "after", 1000) % F.length("change") != 0)
    return p.join(base, "id", "left").withColumn("after", F.when(F.col("applicable"), after)).withColumn("before", F.when(F.col("applicable"), F.col("before")))


def perturbation_run(spark: SparkSession, d: str) -> DataFrame:
    """Problems by perturbations with their statistics, and the interval of the retention over resampled problems."""
    run = _run(spark, d)
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    ci = robustness.bootstrap_metric(run, "id", "change", {"b": (both & F.col("before")).cast("int"), "a": (both & F.col("after")).cast("int")}, F.when(F.col("b") > 0, F.col("a") / F.col("b")))
    return robustness.retention(run).join(ci.select(F.col("group").alias("change"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high")), "change", "left")


QUERIES = {f.__name__: f for f in (unit_change, reordering, number_swap, label_preserving, perturbation_stats, robustness_geomean, bootstrap_accuracy, bootstrap_kappa, seed_intervals, perturbed, perturbation_run)}

_SENT = rf"list_filter(list_transform(string_split(regexp_replace({strip_sql('problem')}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: {strip_sql('s')}), lambda s: s <> '')"
_PRO = perturb.PRONOUNS
_SCALED = r"CASE WHEN abs(v - round(v)) < 1e-9 THEN CAST(CAST(round(v) AS BIGINT) AS VARCHAR) ELSE regexp_replace(regexp_replace(format('{:.6f}', v), '0+$', ''), '\.$', '') END"
_CASES = " ".join(rf"WHEN regexp_matches(problem, '(?i)\b({w})\b') THEN" + " {" + str(k) + "}" for k, (w, _, _) in enumerate(perturb.UNITS))
_UNIT_TEXT = _CASES.format(*(rf"regexp_replace(problem, '(?i)\b({w})\b', '{u}', 'g')" for w, u, _ in perturb.UNITS))
_UNIT_FACTOR = _CASES.format(*(f"{f}" for _, _, f in perturb.UNITS))
_PROBLEMS = "p AS MATERIALIZED (SELECT id, coalesce(problem, '') AS problem, coalesce(answer, '') AS answer, full_solution FROM problems)"
_OUTCOMES = """t AS (SELECT path_id, min(problem_id) AS problem_id, any_value(is_correct) AS ok, min(generation_metadata.model) AS change FROM reasoning_paths GROUP BY 1),
base AS (SELECT problem_id, CASE WHEN count(ok) = 0 THEN NULL ELSE 2 * count(*) FILTER (ok) > count(ok) END AS before FROM t GROUP BY 1), aft AS (SELECT change, problem_id, CASE WHEN count(ok) = 0 THEN NULL ELSE 2 * count(*) FILTER (ok) > count(ok) END AS after FROM t WHERE change IS NOT NULL GROUP BY 1, 2),
o AS (SELECT change, before, after, before IS NOT NULL AND after IS NOT NULL AS inb FROM aft JOIN base USING (problem_id)),
r0 AS (SELECT change, count(*) AS n, count(*) AS n_applicable, count(*) FILTER (inb) AS matched, count(*) FILTER (inb AND before) AS n_before, count(*) FILTER (inb AND after) AS n_after FROM o GROUP BY 1),
r AS (SELECT *, 1.0 AS applicability, round(CASE WHEN n_before = 0 THEN 0.0 ELSE n_after / n_before END, 9) AS retention FROM r0)"""
_DRAW = lambda name: f"CAST('0x' || left(md5(id || ':{name}:0'), 8) AS BIGINT)"
_LIST = lambda texts: "[" + ", ".join(f"'{t}'" for t in texts) + "]"
_ASIDE = f"({_LIST(perturb.ASIDES)})[{_DRAW('aside')} % {len(perturb.ASIDES)} + 1] || ' ' || ltrim(problem)"
_POOL = f"list_filter([7, 11, 13, 17, 19, 23], lambda n: num IS NULL OR abs(n - num) > 1e-9)"
_SAID = f"replace(({_LIST(perturb.DISTRACTORS)})[{_DRAW('distractor')} % {len(perturb.DISTRACTORS)} + 1], '{{}}', CAST({_POOL}[{_DRAW('number')} % len({_POOL}) + 1] AS VARCHAR))"
_SO = r"(?s)([A-Z])([^.!?]*?),\s+so\s+([a-z])(.*)$"
_RULES = rf"""list_filter([
    CASE WHEN contains(lower(problem), ' and then ') THEN regexp_replace(problem, '(?i)\s+and then\s+', '; after that ') END,
    CASE WHEN regexp_matches(problem, '{_SO}') THEN 'Because ' || lower(regexp_extract(problem, '{_SO}', 1)) || regexp_extract(problem, '{_SO}', 2) || ', ' || upper(regexp_extract(problem, '{_SO}', 3)) || regexp_extract(problem, '{_SO}', 4) END,
    CASE WHEN contains(lower(problem), ' after ') THEN regexp_replace(problem, '(?i)\bafter\b', 'following') END,
    CASE WHEN regexp_matches(problem, '(?i)\bbuys\b') AND NOT regexp_matches(regexp_extract(problem, '(?is)^(.*?)\bbuys\b', 1), '(?i)\bbuy\b') THEN regexp_replace(problem, '(?i)\bbuys\b', 'purchases') WHEN regexp_matches(problem, '(?i)\bbuy\b') THEN regexp_replace(problem, '(?i)\bbuy\b', 'purchase') END,
    CASE WHEN contains(lower(problem), ' each ') THEN regexp_replace(problem, '(?i)\beach\b', 'per item') END,
    CASE WHEN regexp_matches(problem, '(?i)\bin total\b') THEN regexp_replace(problem, '(?i)\bin total\b', 'altogether') END], lambda r: r IS NOT NULL AND r <> problem)"""
_LABEL = f"""{_PROBLEMS}, pq AS MATERIALIZED (SELECT *, {_float("answer")} AS num, {_SENT} AS s, {_RULES} AS rules FROM p),
lp AS MATERIALIZED (SELECT id, problem, answer, full_solution, num, s, rules, {_ASIDE} AS aside, CASE WHEN len(s) >= 2 THEN array_to_string(list_concat([s[1], {_SAID}], s[2:]), ' ') ELSE rtrim(problem) || ' ' || {_SAID} END AS distractor, rules[{_DRAW("rule")} % greatest(len(rules), 1) + 1] AS paraphrase FROM pq)"""
_STEP = r"'<<([^<>=]+)=([^<>]+)>>'"
_PRODUCT = r"'^\s*(-?\d+(?:\.\d+)?)\s*\*\s*(-?\d+(?:\.\d+)?)\s*$'"
_PLACES = r"len(regexp_extract_all(' ' || regexp_replace(problem, '([^\w.])', '\1\1', 'g') || ' ', '[^\w.]-?' || replace(ltrim(f, '-'), '.', '\.') || '[^\w.]'))"
_SWAP = f"""sw0 AS MATERIALIZED (SELECT id, problem, full_solution, {_float("answer")} AS a, list_last(regexp_extract_all(full_solution, {_STEP}, 1)) AS step, {strip_sql(f"list_last(regexp_extract_all(full_solution, {_STEP}, 2))")} AS res FROM p),
sw1 AS MATERIALIZED (SELECT *, {_float("res")} AS r, [regexp_extract(step, {_PRODUCT}, 1), regexp_extract(step, {_PRODUCT}, 2)] AS fs FROM sw0),
sw2 AS MATERIALIZED (SELECT *, list_filter(fs, lambda f: f <> '' AND TRY_CAST(f AS DOUBLE) <> 0 AND abs(TRY_CAST(f AS DOUBLE) - a) >= 1e-9 AND {_PLACES} = 1) AS safe FROM sw1),
sw3 AS MATERIALIZED (SELECT *, CASE WHEN full_solution IS NULL OR full_solution = '' THEN 'no_solution' WHEN step IS NULL THEN 'no_step_markers' WHEN a IS NULL OR r IS NULL THEN 'non_numeric_answer' WHEN abs(a - r) > 1e-6 THEN 'answer_neq_final_step' WHEN NOT regexp_matches(step, {_PRODUCT}) THEN 'non_multiplicative_final' WHEN len(safe) = 0 THEN 'no_safe_operand' END AS reason, safe[{_DRAW("factor")} % greatest(len(safe), 1) + 1] AS pick FROM sw2),
sw4 AS MATERIALIZED (SELECT *, CAST(greatest(1, round(CAST(pick AS DOUBLE) / 2)) AS BIGINT) AS lo, CAST(greatest(2, round(CAST(pick AS DOUBLE) * 2)) AS BIGINT) AS hi FROM sw3),
sw5 AS MATERIALIZED (SELECT *, lo + {_DRAW("value")} % (hi - lo + 1) AS v0 FROM sw4),
sw6 AS MATERIALIZED (SELECT *, CASE WHEN v0 = CAST(pick AS DOUBLE) THEN CASE WHEN CAST(pick AS DOUBLE) < hi THEN hi ELSE lo END ELSE v0 END AS nv FROM sw5),
swap AS (SELECT id, reason IS NULL AS applicable, reason, CASE WHEN reason IS NULL THEN pick END AS operand, CASE WHEN reason IS NULL THEN CAST(nv AS VARCHAR) END AS new_operand, CASE WHEN reason IS NULL THEN {_SCALED} END AS new_answer FROM (SELECT *, a * nv / CAST(pick AS DOUBLE) AS v FROM sw6))"""
_UNIT = f"un AS (SELECT id, CASE WHEN num IS NULL THEN 'non_numeric_answer' WHEN t IS NULL THEN 'no_recognized_unit' END AS reason FROM (SELECT id, {_float('answer')} AS num, CASE {_UNIT_TEXT} END AS t FROM p))"
_ORDER = f"""od AS (SELECT id, CASE WHEN len(s) < 3 THEN 'too_few_sentences' WHEN regexp_matches(s[1], '{_PRO}') THEN 'pronoun_in_s1' WHEN regexp_matches(regexp_extract(s[2], '^\\W*(\\w+)', 1), '{_PRO}') THEN 'pronoun_at_s2_start' END AS reason FROM lp)""".replace("\\\\", "\\")
_ALL = f"""{_LABEL}, {_SWAP}, {_UNIT}, {_ORDER}, allp AS (SELECT id, 'number_swap' AS change, reason FROM swap UNION ALL SELECT id, 'unit_change', reason FROM un UNION ALL SELECT id, 'irrelevant_context', NULL FROM p UNION ALL SELECT id, 'distractor_sentence', NULL FROM p
UNION ALL SELECT id, 'paraphrase', CASE WHEN len(rules) = 0 THEN 'no_rule' END FROM lp UNION ALL SELECT id, 'reordering', reason FROM od)"""
_WEIGHT = "CASE " + " ".join(f"WHEN u >= {start!r}::DOUBLE THEN {k}" for k, start in reversed(list(enumerate(robustness.STARTS, 1)))) + " ELSE 0 END"
_LIMITS = "list_sort(list(m))[CAST(greatest(0, floor(0.025000000000000022::DOUBLE * count(m))) AS INT) + 1] AS low, list_sort(list(m))[CAST(least(count(m) - 1, ceil(0.975::DOUBLE * count(m)) - 1) AS INT) + 1] AS high"


def _bootstrap(source: str, key: str, sums: dict[str, str], metric: str) -> str:
    """Value and limits of a metric over rows of source, which has grp and key."""
    cols = ", ".join(f"{e} AS {n}" for n, e in sums.items())
    total = ", ".join(f"sum({n}) AS {n}" for n in sums)
    drawn = ", ".join(f"sum(w * {n}) AS {n}" for n in sums)
    return f"""bs AS MATERIALIZED (SELECT grp, {key} AS k, {cols} FROM {source} WHERE grp IS NOT NULL), dr AS (SELECT bs.*, b, {_WEIGHT} AS w FROM (SELECT *, CAST('0x' || left(md5(k || ':' || b || ':0'), 8) AS BIGINT) / 4294967296.0 AS u FROM bs, range(1, 201) r(b)) bs),
    mt AS (SELECT grp, {metric} AS m FROM (SELECT grp, b, {drawn} FROM dr WHERE w > 0 GROUP BY 1, 2)), lm AS (SELECT grp, {_LIMITS} FROM mt WHERE m IS NOT NULL GROUP BY 1), wh AS (SELECT grp, {metric} AS value FROM (SELECT grp, {total} FROM bs GROUP BY 1)),
    boot AS (SELECT wh.grp AS "group", value, low, high FROM wh LEFT JOIN lm USING (grp))"""


_KAPPA = "CASE WHEN tp + fp + fn + tn > 0 AND abs(1 - (((tp + fn) / (tp + fp + fn + tn)) * ((tp + fp) / (tp + fp + fn + tn)) + (1 - (tp + fn) / (tp + fp + fn + tn)) * (1 - (tp + fp) / (tp + fp + fn + tn)))) > 1e-12 THEN ((tp + tn) / (tp + fp + fn + tn) - (((tp + fn) / (tp + fp + fn + tn)) * ((tp + fp) / (tp + fp + fn + tn)) + (1 - (tp + fn) / (tp + fp + fn + tn)) * (1 - (tp + fp) / (tp + fp + fn + tn)))) / (1 - (((tp + fn) / (tp + fp + fn + tn)) * ((tp + fp) / (tp + fp + fn + tn)) + (1 - (tp + fn) / (tp + fp + fn + tn)) * (1 - (tp + fp) / (tp + fp + fn + tn)))) END"
_R6 = 'SELECT "group", round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high FROM boot'
SQL = {
    "unit_change": f"""WITH {_PROBLEMS}, q AS (SELECT *, {_float("answer")} AS num, CASE {_UNIT_TEXT} END AS t, CASE {_UNIT_FACTOR} END AS f FROM p), s AS (SELECT *, num IS NOT NULL AND t IS NOT NULL AS ok, num * f AS v FROM q)
        SELECT id, md5(CASE WHEN ok THEN t ELSE problem END) AS text_md5, CASE WHEN ok THEN {_SCALED} END AS new_answer, ok AS applicable, CASE WHEN num IS NULL THEN 'non_numeric_answer' WHEN t IS NULL THEN 'no_recognized_unit' END AS reason FROM s""",
    "reordering": rf"""WITH {_PROBLEMS}, q AS MATERIALIZED (SELECT *, {_SENT} AS s FROM p), r AS (SELECT *, CASE WHEN len(s) < 3 THEN 'too_few_sentences' WHEN regexp_matches(s[1], '{_PRO}') THEN 'pronoun_in_s1' WHEN regexp_matches(regexp_extract(s[2], '^\W*(\w+)', 1), '{_PRO}') THEN 'pronoun_at_s2_start' END AS reason FROM q)
        SELECT id, md5(CASE WHEN reason IS NULL THEN array_to_string(list_concat([s[2], s[1]], s[3:]), ' ') ELSE problem END) AS text_md5, reason IS NULL AS applicable, reason, len(s) AS n_sentences FROM r""",
    "perturbation_stats": f"WITH {_OUTCOMES} SELECT * FROM r",
    "robustness_geomean": f"WITH {_OUTCOMES} SELECT count(*) AS changes, round(CASE WHEN min(retention) <= 0 THEN 0.0 ELSE exp(avg(ln(CASE WHEN retention > 0 THEN retention END))) END, 6) AS geomean FROM r",
    "number_swap": f"WITH {_PROBLEMS}, {_SWAP} SELECT id, applicable, reason, operand, new_operand, new_answer FROM swap",
    "label_preserving": f"WITH {_LABEL} SELECT id, aside, distractor, paraphrase, len(rules) AS n_rules FROM lp",
    "bootstrap_accuracy": f"WITH t AS (SELECT path_id, min(generation_metadata.model) AS grp, any_value(is_correct) AS ok FROM reasoning_paths GROUP BY 1), {_bootstrap("(SELECT * FROM t WHERE ok IS NOT NULL)", "path_id", {"k1": "CAST(ok AS INT)", "n1": "1"}, "k1 / n1")} {_R6}",
    "bootstrap_kappa": f"""WITH v AS (SELECT path_id, lower(trim(judge_id)) AS judge, verdict, row_number() OVER (PARTITION BY path_id, lower(trim(judge_id)) ORDER BY judged_at DESC NULLS LAST, verdict DESC NULLS LAST) AS k FROM judge_verdicts), t AS (SELECT path_id, any_value(is_correct) AS b FROM reasoning_paths GROUP BY 1),
        j AS (SELECT path_id, judge AS grp, CASE upper(regexp_replace(verdict, '[^A-Za-z]', '', 'g')) WHEN 'ACCEPT' THEN true WHEN 'REJECT' THEN false END AS a, b AS bb FROM v JOIN t USING (path_id) WHERE k = 1), {_bootstrap("j", "path_id", {"tp": "coalesce(CAST(a AND bb AS INT), 0)", "fp": "coalesce(CAST(NOT a AND bb AS INT), 0)", "fn": "coalesce(CAST(a AND NOT bb AS INT), 0)", "tn": "coalesce(CAST(NOT a AND NOT bb AS INT), 0)"}, _KAPPA)} {_R6}""",
    "seed_intervals": f"""WITH p AS (SELECT provenance.generator_model AS model, provenance.generation_seed % 5 AS seed, unnest([{{'metric': 'quality', 'v': quality_score}}, {{'metric': 'temperature', 'v': provenance.generation_temperature}}], recursive := true) FROM dpo_pairs_v1 WHERE provenance.generator_model IS NOT NULL AND provenance.generation_seed IS NOT NULL),
        m0 AS (SELECT model, metric, seed, round(avg(v), 6) AS m FROM p WHERE v IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT *, model || ' ' || metric AS grp, count(*) OVER (PARTITION BY model, metric) AS n FROM m0), kept AS (SELECT * FROM m WHERE n = (SELECT count(DISTINCT seed) FROM p WHERE p.model = m.model)),
        {_bootstrap("kept", "seed", {"s1": "m", "c1": "1"}, "s1 / c1")}, sd AS (SELECT grp, any_value(n) AS n, round(coalesce(stddev_samp(m), 0.0), 5) AS std FROM kept GROUP BY 1) SELECT "group", n, std, round(value, 5) AS value, round(low, 5) AS low, round(high, 5) AS high FROM boot JOIN sd ON sd.grp = boot."group" """,
    "perturbation_run": f"""WITH {_ALL}, t AS (SELECT path_id, min(problem_id) AS id, any_value(is_correct) AS ok FROM reasoning_paths GROUP BY 1), base AS (SELECT id, CASE WHEN count(ok) = 0 THEN NULL ELSE 2 * count(*) FILTER (ok) > count(ok) END AS bf FROM t GROUP BY 1),
        run AS (SELECT id, change AS grp, reason IS NULL AS applicable, CASE WHEN reason IS NULL THEN bf END AS before, CASE WHEN reason IS NULL THEN bf AND ({_DRAW("after")} % 1000) % length(change) <> 0 END AS after FROM allp LEFT JOIN base USING (id)),
        {_bootstrap("run", "id", {"b1": "coalesce(CAST(before AND after IS NOT NULL AS INT), 0)", "a1": "coalesce(CAST(after AND before IS NOT NULL AS INT), 0)"}, "CASE WHEN b1 > 0 THEN a1 / b1 END")},
        st AS (SELECT grp, count(*) AS n, count(*) FILTER (applicable) AS n_applicable, count(*) FILTER (applicable AND before IS NOT NULL AND after IS NOT NULL) AS matched, count(*) FILTER (applicable AND before AND after IS NOT NULL) AS n_before, count(*) FILTER (applicable AND after AND before IS NOT NULL) AS n_after FROM run GROUP BY 1)
        SELECT grp AS change, n, n_applicable, matched, n_before, n_after, round(n_applicable / n, 9) AS applicability, round(CASE WHEN n_before = 0 THEN 0.0 ELSE n_after / n_before END, 9) AS retention, round(low, 6) AS low, round(high, 6) AS high FROM st JOIN boot ON boot."group" = st.grp""",
    "perturbed": rf"""WITH {_ALL}, sx AS (SELECT p.id, p.problem, w.new_answer, CASE WHEN w.applicable THEN regexp_replace(p.problem, '(^|[^\w.])-?' || replace(ltrim(w.operand, '-'), '.', '\.') || '($|[^\w.])', '\1' || w.new_operand || '\2') ELSE p.problem END AS t FROM swap w JOIN p USING (id)),
        ux AS (SELECT id, CASE WHEN num IS NOT NULL AND t IS NOT NULL THEN t ELSE problem END AS t, CASE WHEN num IS NOT NULL AND t IS NOT NULL THEN {_SCALED} END AS a FROM (SELECT *, num * f AS v FROM (SELECT *, {_float("answer")} AS num, CASE {_UNIT_TEXT} END AS t, CASE {_UNIT_FACTOR} END AS f FROM p))),
        tx AS (SELECT id, 'number_swap' AS change, true AS rewrites, t, new_answer AS a FROM sx UNION ALL SELECT id, 'unit_change', true, t, a FROM ux UNION ALL SELECT id, 'irrelevant_context', false, aside, NULL FROM lp UNION ALL SELECT id, 'distractor_sentence', false, distractor, NULL FROM lp
            UNION ALL SELECT id, 'paraphrase', false, coalesce(paraphrase, problem), NULL FROM lp UNION ALL SELECT lp.id, 'reordering', false, CASE WHEN od.reason IS NULL THEN array_to_string(list_concat([s[2], s[1]], s[3:]), ' ') ELSE problem END, NULL FROM lp JOIN od USING (id))
        SELECT tx.id, tx.change, rewrites, reason IS NULL AS applicable, reason, coalesce(a, p.answer) AS new_answer, md5(t) AS text_md5 FROM tx JOIN allp ON allp.id = tx.id AND allp.change = tx.change JOIN p ON p.id = tx.id""",
}
