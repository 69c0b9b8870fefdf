"""Queries that prepare training inputs and summarise runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators import training
from tracemill.operators.ranking import place_in_group
from tracemill.plans.views import BLANK, TRACES, strip_sql, words_sql
from tracemill.plans.views import traces as traces_view
from tracemill.runtime import compute_once, table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dpo_pairs_v1").select(F.col("provenance.pair_id").alias("ord"), "pair.prompt", F.coalesce("pair.chosen", F.lit("")).alias("chosen"), F.coalesce("pair.rejected", F.lit("")).alias("rejected"), F.col("pair.expected_answer").alias("expected")).dropDuplicates(["ord"])


def grpo_groups(spark: SparkSession, d: str) -> DataFrame:
    g = training.groups(_pairs(spark, d))
    return g.select(F.md5("prompt").alias("prompt_md5"), F.size("chosen").alias("n"), F.md5(F.array_join("chosen", "|")).alias("chosen_md5"), F.md5(F.array_join("rejected", "|")).alias("rejected_md5"), "expected")


def grpo_advantages(spark: SparkSession, d: str) -> DataFrame:
    t = traces_view(spark, d).select("ord", "problem_id", F.col("is_correct").cast("double").alias("reward"))
    return training.advantages(t).select("ord", F.round("advantage", 6).alias("advantage"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select(F.col("ord").alias("key"), F.expr("inline(array(struct('chosen' AS side, chosen AS t), struct('rejected' AS side, rejected AS t)))"))
    s = p.select("key", "side", F.posexplode(X.extract_steps(F.col("t"))).alias("i", "step"))
    return compute_once(s, {"label": training.equation_label(F.col("step"))}).select("key", "side", "i", "label")


def step_labels(spark: SparkSession, d: str) -> DataFrame:
    return training.step_labels(_steps(spark, d))


def step_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Per place: right steps joined with wrong ones of the same pair and place."""
    s = training.step_labels(_steps(spark, d))
    good = s.where("label = 1").select("key", "i", F.col("side").alias("good_side"))
    bad = s.where("label = 0").select("key", "i", F.col("side").alias("bad_side"))
    return good.join(bad, ["key", "i"]).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("pairs"))


def seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation over seeds of each model's mean quality; models that lack a seed are left out."""
    p = table(spark, d, "dpo_pairs_v1").select(F.col("provenance.generator_model").alias("model"), (F.col("provenance.generation_seed") % 3).alias("seed"), F.col("quality_score").alias("q")).where("model is not null and seed is not null and q is not null")
    m = p.groupBy("model", "seed").agg(F.avg("q").alias("m"))
    n = m.select("seed").distinct().agg(F.count(F.lit(1)).alias("n_seeds"))
    a = m.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 6).alias("std"))
    return a.crossJoin(F.broadcast(n)).where("n = n_seeds").select("model", "n", "mean", "std")


def _history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("score"))


def training_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per run of the event stream: first and last value, the change in percent, and the mean of those that aren't 0."""
    h = _history(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("steps"), F.min_by("score", "step").alias("a"), F.max_by("score", "step").alias("b"), F.avg(F.nullif("score", F.lit(0.0))).alias("m"), F.max("score").alias("top"))
    pct = F.coalesce(F.try_divide((F.col("a") - F.col("b")) * 100, F.col("a")), F.lit(0.0))
    return h.select("run", "steps", F.round("a", 6).alias("first"), F.round("b", 6).alias("last"), F.round(pct, 4).alias("reduction_pct"), F.round("m", 4).alias("mean"), F.round("top", 6).alias("top"))


def best_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Per user as a run: the running best of its hourly values."""
    h = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("run"), F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("score"))
    h = h.select("run", F.unix_timestamp("day").alias("step"), F.round("score", 6).alias("score"))
    return training.best_checkpoint(h, 0.5)


def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Orders as steps: rows, mean and interpolated percentiles per priority."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stage"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.percentile("o_totalprice", 0.95), 4).alias("p95"), F.round(F.percentile("o_totalprice", 0.99), 4).alias("p99"))


def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    """The value at place round(p (n - 1)), halves to even, per status."""
    r = place_in_group(table(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey"), "o_orderstatus", "o_totalprice", "o_orderkey", place="k", size="n")
    hit = r.where(F.col("k") - 1 == F.bround(0.95 * (F.col("n") - 1)))
    return hit.select(F.col("o_orderstatus").alias("status"), "n", F.round("o_totalprice", 4).alias("p95"))


def scaling(spark: SparkSession, d: str) -> DataFrame:
    """Speed-up of each supplier nation over the smallest, and its efficiency per supplier."""
    l = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = l.groupBy("s_nationkey").agg(F.sum("l_quantity").alias("samples"), F.count_distinct("s_suppkey").alias("workers"))
    base = g.agg(F.min(F.struct("samples", "workers")).alias("b")).select(F.col("b.samples").alias("base"), F.col("b.workers").alias("base_workers"))
    s = g.crossJoin(F.broadcast(base)).withColumn("speedup", F.col("samples") / F.col("base"))
    return s.select("s_nationkey", "workers", F.round("speedup", 6).alias("speedup"), F.round(100 * F.col("speedup") * F.col("base_workers") / F.col("workers"), 4).alias("efficiency"))


def running_median_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Length penalty against the median of the last 20 lengths of a problem, in order of arrival."""
    t = traces_view(spark, d).select("ord", "problem_id", F.length("reasoning").alias("n"))
    w = Window.partitionBy("problem_id").orderBy("ord").rowsBetween(-19, Window.currentRow)
    m = t.withColumn("median", F.floor(F.percentile("n", 0.5).over(w)))
    return m.select("ord", "median", F.round(X.length_penalty(F.col("n"), F.col("median")), 6).alias("penalty"))


def running_median_whole(spark: SparkSession, d: str) -> DataFrame:
    """Length penalty against the median of all lengths of a problem so far, in order of arrival."""
    t = traces_view(spark, d).select("ord", F.col("problem_id").alias("part"), F.length("reasoning").alias("n"))
    return training.running_median(t).select("ord", "median", F.round(X.length_penalty(F.col("n"), F.col("median")), 6).alias("penalty"))


def summary_diff(spark: SparkSession, d: str) -> DataFrame:
    """Counts per source of one split against another; only sources that both have."""
    p = table(spark, d, "problems").groupBy("source_dataset", "source_split").agg(F.count(F.lit(1)).alias("n"))
    a, b = p.where("source_split = 'train'"), p.where("source_split = 'test'")
    return a.select("source_dataset", F.col("n").alias("current")).join(b.select("source_dataset", F.col("n").alias("previous")), "source_dataset").withColumn("delta", F.col("current") - F.col("previous"))


def chat_render(spark: SparkSession, d: str) -> DataFrame:
    """Problems as a chat of role and content lines, with the opening of an answer."""
    p = table(spark, d, "problems")
    system = F.when(F.col("entry_point").isNotNull(), "You write correct code.").otherwise("You reason step by step.")
    m = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), F.coalesce("problem", F.lit("")).alias("content")))
    chat = F.concat(F.array_join(F.transform(m, lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["content"])), "\n"), F.lit("\n<|assistant|>\n"))
    return p.select("id", F.md5(chat).alias("chat_md5"), F.length(chat).alias("n_chars"))


def replicate(spark: SparkSession, d: str) -> DataFrame:
    """Each problem four times, numbered."""
    return table(spark, d, "problems").select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))


def prefix_match(spark: SparkSession, d: str) -> DataFrame:
    """For each evaluation item, the longest run of first words that a problem begins with.

    Heads of up to 32 words are met first; what agrees in all of them goes on
    with a chain of digests over its other words.
    """
    most = 32
    all_items = compute_once(table(spark, d, "eval_items").select("item_id", "item_text"), {"all": X.words(F.col("item_text"))}).select("item_id", "all", F.slice("all", 1, most).alias("w"))
    all_problems = compute_once(table(spark, d, "problems").select("id", F.coalesce("problem", F.lit("")).alias("problem")), {"all": X.words(F.col("problem"))}).select("id", "all", F.slice("all", 1, most).alias("w"))
    items, problems = all_items.select("item_id", "w"), all_problems.select("id", "w")
    heads = lambda df, key: df.where(F.size("w") > 0).select(key, F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n"), "w").select(key, "n", F.md5(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ")).alias("h"))
    seen = heads(problems, "id").select("n", "h").distinct()
    hit = heads(items, "item_id").join(seen, ["n", "h"]).groupBy("item_id").agg(F.max("n").alias("n"))
    head = F.md5(F.array_join("w", " "))
    long = lambda df, key: df.where(F.size("all") > most).select(key, "all", head.alias("head"))
    chain = F.aggregate(F.slice("all", F.lit(most + 1), F.greatest(F.size("all") - most, F.lit(1))), F.array("head"), lambda acc, x: F.concat(acc, F.array(F.md5(F.concat(F.element_at(acc, -1), x)))))
    chained = lambda df, key: df.select(key, F.posexplode(chain).alias("k", "h")).where("k > 0")
    more_items = long(all_items, "item_id")
    more_problems = long(all_problems, "id").join(more_items.select("head").distinct(), "head", "left_semi")
    more = chained(more_items, "item_id").join(chained(more_problems, "id").select("k", "h").distinct(), ["k", "h"]).groupBy("item_id").agg((F.max("k") + most).alias("n"))
    hit = hit.unionByName(more).groupBy("item_id").agg(F.max("n").alias("n"))
    return items.select("item_id").join(hit, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_words"))


def prefix_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Problems in order of their words, so that common beginnings lie together."""
    p = compute_once(table(spark, d, "problems").select("id", "source_dataset", F.coalesce("problem", F.lit("")).alias("problem")), {"w": X.words(F.col("problem"))})
    placed = place_in_group(p.select("id", "source_dataset", F.array_join("w", " ").alias("text")), "source_dataset", "text", "id")
    return placed.select("id", "source_dataset", "place")


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Traces of each model in batches of 32 in order of arrival."""
    t = place_in_group(traces_view(spark, d).where("model is not null").select("model", "ord", F.length("reasoning").alias("chars")), "model", "ord", place="k")
    return t.groupBy("model", F.ceil(F.col("k") / 32).cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.sum("chars").alias("chars"))


def train_eval_split(spark: SparkSession, d: str) -> DataFrame:
    """The first nine tenths of each source by id for training."""
    p = place_in_group(table(spark, d, "problems").select("id", "source_dataset"), "source_dataset", "id", place="k", size="n")
    return p.select("id", F.when(F.col("k") <= F.floor(F.col("n") * 0.9), "train").otherwise("eval").alias("part"))


def message_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Traces as keyed messages of two topics, written as JSON and read back; training_messages has the pairs."""
    from tracemill.streaming.messages import envelope, open_envelope

    t = table(spark, d, "reasoning_paths").dropDuplicates(["path_id"])
    raw = envelope(t.select(F.col("problem_id").alias("key"), F.struct("path_id", "final_answer").alias("data")), "reasoning-raw", "raw_reasoning")
    good = envelope(t.where("is_correct").select(F.col("problem_id").alias("key"), F.struct("path_id", "final_answer").alias("data")), "reasoning-verified", "verified_path")
    back = open_envelope(raw.unionByName(good), "path_id long, final_answer string")
    return back.groupBy("topic", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"), F.count("data.final_answer").alias("n_answers"), F.sum("data.path_id").alias("id_sum"))


def training_messages(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as keyed messages of the topic for training, written as JSON and read back."""
    from tracemill.streaming.messages import TOPICS, envelope, open_envelope

    sent = envelope(_pairs(spark, d).select(F.col("ord").alias("key"), F.struct("prompt", "chosen", "rejected").alias("data")), TOPICS["training_sample"], "training_sample")
    back = open_envelope(sent, "prompt string, chosen string, rejected string")
    return back.groupBy("topic", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"), F.count("data.prompt").alias("n_prompts"), F.sum(F.length("data.chosen") + F.length("data.rejected")).alias("n_chars"))


QUERIES = {
    f.__name__: f
    for f in (grpo_groups, grpo_advantages, step_labels, step_pairs, seed_aggregate, training_summary, best_checkpoint, throughput, nearest_rank, scaling, running_median_penalty, running_median_whole, summary_diff, chat_render, replicate, prefix_match, prefix_schedule, batches, train_eval_split, message_envelope, training_messages)
}

_PAIRS = "prs AS MATERIALIZED (SELECT provenance.pair_id AS ord, any_value(pair.prompt) AS prompt, coalesce(any_value(pair.chosen), '') AS chosen, coalesce(any_value(pair.rejected), '') AS rejected, any_value(pair.expected_answer) AS expected FROM dpo_pairs_v1 GROUP BY 1)"
_EQ = r"(-?\d+(?:\.\d+)?)\s*([-+*/])\s*(-?\d+(?:\.\d+)?)\s*=\s*(-?\d+(?:\.\d+)?)"
_LABELS = rf"""sides AS (SELECT ord AS key, 'chosen' AS side, chosen AS t FROM prs UNION ALL SELECT ord, 'rejected', rejected FROM prs),
ls AS (SELECT key, side, list_filter(list_transform(string_split(t, chr(10)), lambda s: {strip_sql(f"regexp_replace(s, '{BLANK}+', ' ', 'g')")}), lambda s: length(s) >= 15) AS steps FROM sides),
st AS (SELECT key, side, unnest(range(len(steps))) AS i, unnest(steps) AS step FROM ls),
eq AS (SELECT key, side, i, regexp_matches(step, '{_EQ}') AS has, TRY_CAST(regexp_extract(step, '{_EQ}', 1) AS DOUBLE) AS a, regexp_extract(step, '{_EQ}', 2) AS op, TRY_CAST(regexp_extract(step, '{_EQ}', 3) AS DOUBLE) AS b, TRY_CAST(regexp_extract(step, '{_EQ}', 4) AS DOUBLE) AS c FROM st),
lb AS (SELECT key, side, i, CASE WHEN has THEN CASE WHEN abs(CASE op WHEN '+' THEN a + b WHEN '-' THEN a - b WHEN '*' THEN a * b ELSE a / nullif(b, 0) END - c) < 1e-6 THEN 1 ELSE 0 END END AS label FROM eq),
fl AS (SELECT *, max(CASE WHEN label = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key, side ORDER BY i) AS failed FROM lb),
labels AS (SELECT key, side, i, CASE WHEN failed = 1 AND side = 'rejected' THEN 0 ELSE label END AS label FROM fl WHERE label IS NOT NULL OR (failed = 1 AND side = 'rejected'))"""
_HEADS = "SELECT {k}, n, md5(array_to_string(w[1:n], ' ')) AS h FROM (SELECT {k}, w, unnest(range(1, len(w) + 1)) AS n FROM {t})"
SQL = {
    "grpo_groups": f"WITH {_PAIRS} SELECT md5(prompt) AS prompt_md5, count(*) AS n, md5(string_agg(chosen, '|' ORDER BY ord)) AS chosen_md5, md5(string_agg(rejected, '|' ORDER BY ord)) AS rejected_md5, first(expected ORDER BY ord) FILTER (expected IS NOT NULL) AS expected FROM prs WHERE prompt IS NOT NULL AND prompt <> '' GROUP BY prompt",
    "grpo_advantages": f"WITH {TRACES}, r AS (SELECT ord, CASE WHEN is_correct THEN 1.0 ELSE 0.0 END AS r, problem_id FROM traces), s AS (SELECT *, avg(r) OVER (PARTITION BY problem_id) AS m, stddev_pop(r) OVER (PARTITION BY problem_id) AS sd FROM r) SELECT ord, round((r - m) / (sd + 1e-8), 6) AS advantage FROM s WHERE sd >= 1e-6",
    "step_labels": f"WITH {_PAIRS}, {_LABELS} SELECT * FROM labels",
    "step_pairs": f"WITH {_PAIRS}, {_LABELS} SELECT g.i, count(*) AS n, count(DISTINCT g.key) AS pairs FROM labels g JOIN labels b ON g.key = b.key AND g.i = b.i AND g.label = 1 AND b.label = 0 GROUP BY 1",
    "seed_aggregate": """WITH p AS (SELECT provenance.generator_model AS model, provenance.generation_seed % 3 AS seed, quality_score AS q FROM dpo_pairs_v1 WHERE provenance.generator_model IS NOT NULL AND provenance.generation_seed IS NOT NULL AND quality_score IS NOT NULL), m AS (SELECT model, seed, avg(q) AS m FROM p GROUP BY 1, 2)
        SELECT model, count(*) AS n, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0.0), 6) AS std FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT seed) FROM m)""",
    "training_summary": "WITH h AS (SELECT event_type AS run, count(*) AS steps, arg_min(value, event_id) AS a, arg_max(value, event_id) AS b, avg(nullif(value, 0.0)) AS m, max(value) AS top FROM events GROUP BY 1) SELECT run, steps, round(a, 6) AS first, round(b, 6) AS last, round(coalesce((a - b) * 100 / nullif(a, 0), 0.0), 4) AS reduction_pct, round(m, 4) AS mean, round(top, 6) AS top FROM h",
    "best_checkpoint": """WITH RECURSIVE h AS (SELECT user_id % 50 AS run, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS step, round(avg(value), 6) AS score FROM events GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM h),
        f AS (SELECT run, k, score, step, 0 AS since FROM o WHERE k = 1 UNION ALL SELECT o.run, o.k, CASE WHEN o.score > f.score + 0.5 THEN o.score ELSE f.score END, CASE WHEN o.score > f.score + 0.5 THEN o.step ELSE f.step END, CASE WHEN o.score > f.score + 0.5 THEN 0 ELSE f.since + 1 END FROM f JOIN o ON o.run = f.run AND o.k = f.k + 1)
        SELECT run, score, step, since FROM f WHERE k = (SELECT max(k) FROM o WHERE o.run = f.run)""",
    "throughput": "SELECT o_orderpriority AS stage, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY 1",
    "nearest_rank": "WITH r AS (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderstatus AS status, n, round(o_totalprice, 4) AS p95 FROM r WHERE k - 1 = round_even(0.95 * (n - 1), 0)",
    "scaling": "WITH g AS (SELECT s_nationkey, sum(l_quantity) AS samples, count(DISTINCT s_suppkey) AS workers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), b AS (SELECT samples AS base, workers AS bw FROM g ORDER BY samples, workers LIMIT 1) SELECT s_nationkey, workers, round(samples / base, 6) AS speedup, round(100 * samples / base * bw / workers, 4) AS efficiency FROM g, b",
    "running_median_penalty": f"WITH {TRACES}, t AS (SELECT ord, problem_id, length(reasoning) AS n FROM traces), m AS (SELECT ord, n, floor(quantile_cont(n, 0.5) OVER (PARTITION BY problem_id ORDER BY ord ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS median FROM t) SELECT ord, CAST(median AS BIGINT) AS median, round(CASE WHEN median <= 0 OR n <= 0 OR n / median <= 2 THEN 1.0 WHEN n / median >= 6 THEN 0.0 WHEN n / median <= 4 THEN 1.0 - 0.5 * (n / median - 2.0) / 2.0 ELSE 0.5 - 0.5 * (n / median - 4.0) / 2.0 END, 6) AS penalty FROM m",
    "running_median_whole": f"WITH {TRACES}, t AS (SELECT ord, problem_id, length(reasoning) AS n FROM traces), m AS (SELECT ord, n, floor(quantile_cont(n, 0.5) OVER (PARTITION BY problem_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS median FROM t) SELECT ord, CAST(median AS BIGINT) AS median, round(CASE WHEN median <= 0 OR n <= 0 OR n / median <= 2 THEN 1.0 WHEN n / median >= 6 THEN 0.0 WHEN n / median <= 4 THEN 1.0 - 0.5 * (n / median - 2.0) / 2.0 ELSE 0.5 - 0.5 * (n / median - 4.0) / 2.0 END, 6) AS penalty FROM m",
    "summary_diff": "WITH p AS (SELECT source_dataset, source_split, count(*) AS n FROM problems GROUP BY 1, 2) SELECT a.source_dataset, a.n AS current, b.n AS previous, a.n - b.n AS delta FROM p a JOIN p b ON a.source_dataset = b.source_dataset AND a.source_split = 'train' AND b.source_split = 'test'",
    "chat_render": "WITH c AS (SELECT id, '<|system|>' || chr(10) || CASE WHEN entry_point IS NOT NULL THEN 'You write correct code.' ELSE 'You reason step by step.' END || chr(10) || '<|user|>' || chr(10) || coalesce(problem, '') || chr(10) || '<|assistant|>' || chr(10) AS chat FROM problems) SELECT id, md5(chat) AS chat_md5, length(chat) AS n_chars FROM c",
    "replicate": "SELECT id, CAST(k AS INT) AS k FROM problems, range(4) r(k)",
    "prefix_match": f"WITH i AS (SELECT item_id, ({words_sql('item_text')})[1:32] AS w FROM eval_items), p AS (SELECT id, ({words_sql("coalesce(problem, '')")})[1:32] AS w FROM problems), hp AS (SELECT DISTINCT n, h FROM ({_HEADS.format(k='id', t='p')})), hi AS ({_HEADS.format(k='item_id', t='i')}), m AS (SELECT item_id, max(n) AS n FROM hi JOIN hp USING (n, h) GROUP BY 1) SELECT item_id, CAST(coalesce(n, 0) AS INT) AS n_words FROM i LEFT JOIN m USING (item_id)",
    "prefix_schedule": f"WITH p AS (SELECT id, source_dataset, array_to_string({words_sql("coalesce(problem, '')")}, ' ') AS w FROM problems) SELECT id, source_dataset, row_number() OVER (PARTITION BY source_dataset ORDER BY w, id) AS place FROM p",
    "batches": f"WITH {TRACES}, t AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ord) AS k FROM traces WHERE model IS NOT NULL) SELECT model, CAST(ceil(k / 32) AS BIGINT) AS batch, count(*) AS n, min(ord) AS first, max(ord) AS last, sum(length(reasoning)) AS chars FROM t GROUP BY 1, 2",
    "train_eval_split": "WITH p AS (SELECT id, row_number() OVER (PARTITION BY source_dataset ORDER BY id) AS k, count(*) OVER (PARTITION BY source_dataset) AS n FROM problems) SELECT id, CASE WHEN k <= floor(n * 0.9) THEN 'train' ELSE 'eval' END AS part FROM p",
    "message_envelope": """WITH t AS (SELECT path_id, any_value(problem_id) AS key, any_value(final_answer) AS fa, any_value(is_correct) AS ok FROM reasoning_paths GROUP BY 1), m AS (SELECT 'reasoning-raw' AS topic, 'raw_reasoning' AS type, * FROM t UNION ALL SELECT 'reasoning-verified', 'verified_path', * FROM t WHERE ok)
        SELECT topic, type, count(*) AS n, count(DISTINCT key) AS n_keys, count(fa) AS n_answers, CAST(sum(path_id) AS BIGINT) AS id_sum FROM m GROUP BY 1, 2""",
    "training_messages": f"WITH {_PAIRS} SELECT 'training-data' AS topic, 'training_sample' AS type, count(*) AS n, count(DISTINCT ord) AS n_keys, count(prompt) AS n_prompts, CAST(sum(length(chosen) + length(rejected)) AS BIGINT) AS n_chars FROM prs",
}
