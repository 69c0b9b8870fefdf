"""Queries on judges' bias, rewards, logs and decoding statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.runtime import table


def _scored_twice(spark: SparkSession, d: str) -> DataFrame:
    """First and last score of each pair as the winner of a forward and a reverse comparison."""
    s = table(spark, d, "sample_pairs").where("diversity_score is not null and not isnan(diversity_score) and scored_at is not null")
    g = s.groupBy("pair_id").agg(F.min(F.struct("scored_at", "diversity_score"))["diversity_score"].alias("f"), F.max(F.struct("scored_at", "diversity_score"))["diversity_score"].alias("r"))
    side = lambda c, a, b: F.when(F.col(c) > 0.6, a).when(F.col(c) < 0.4, b).otherwise("TIE")
    return g.select("pair_id", side("f", "A", "B").alias("forward"), side("r", "A", "B").alias("reverse"), F.col("f").alias("cf"), F.col("r").alias("cr"))


def swapped(forward: Column, reverse: Column, cf: Column, cr: Column) -> Column:
    """Winner and confidence of two comparisons in both orders: unstable ones are a tie at half the greater confidence."""
    stable = forward == reverse
    return F.struct(F.when(stable, forward).otherwise("TIE").alias("winner"), F.when(stable, (cf + cr) / 2).otherwise(F.greatest(cf, cr) / 2).alias("confidence"), stable.alias("stable"))


def pairwise_swap(spark: SparkSession, d: str) -> DataFrame:
    s = _scored_twice(spark, d).withColumn("v", swapped(F.col("forward"), F.col("reverse"), F.col("cf"), F.col("cr")))
    return s.select("pair_id", "v.winner", F.round("v.confidence", 6).alias("confidence"), "v.stable")


def swap_stability(spark: SparkSession, d: str) -> DataFrame:
    s = _scored_twice(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("forward") == F.col("reverse")).alias("n_stable"))
    return s.withColumn("swap_rate", F.round(F.coalesce(1 - F.try_divide("n_stable", "n"), F.lit(0.0)), 9))


def self_preference(spark: SparkSession, d: str) -> DataFrame:
    """Per model: share of its traces found correct, less that of all others."""
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.min("generation_metadata.model").alias("model"), F.first("is_correct").alias("ok")).where("model is not null and ok is not null")
    g = t.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("k"))
    total = g.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    return g.crossJoin(F.broadcast(total)).select("model", "n", F.round(F.col("k") / F.col("n") - F.coalesce(F.try_divide(F.col("tk") - F.col("k"), F.col("tn") - F.col("n")), F.lit(0.0)), 9).alias("delta"))


def truncate_to_shortest(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of a pair cut to the length of the shorter, against favour for length."""
    p = table(spark, d, "dpo_pairs_v1").select("provenance.pair_id", F.coalesce("pair.chosen", F.lit("")).alias("c"), F.coalesce("pair.rejected", F.lit("")).alias("r")).dropDuplicates(["pair_id"])
    n = F.least(F.length("c"), F.length("r"))
    return p.select("pair_id", n.alias("n"), F.md5(F.substring("c", F.lit(1), n)).alias("chosen_md5"), F.md5(F.substring("r", F.lit(1), n)).alias("rejected_md5"))


def policy_terms(spark: SparkSession, d: str) -> DataFrame:
    """Clipped policy loss and divergence of given log-probabilities: a trace's confidence against the mean of its model."""
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.min("generation_metadata.model").alias("model"), F.first("confidence").alias("c"), F.first("is_correct").alias("ok")).where("model is not null and c > 0")
    old = t.groupBy("model").agg(F.avg(F.ln("c")).alias("old"))
    advantage = F.when(F.col("ok"), 1.0).otherwise(-1.0)
    j = t.join(old, "model").withColumn("ratio", F.exp(F.ln("c") - F.col("old")))
    clipped = F.least(F.greatest("ratio", F.lit(0.8)), F.lit(1.2))
    k = F.exp(F.col("old") - F.ln("c")) - (F.col("old") - F.ln("c")) - 1
    return j.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(-F.avg(F.least(F.col("ratio") * advantage, clipped * advantage)), 5).alias("loss"), F.round(F.avg(k), 5).alias("kl"))


def acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Drafted tokens accepted up to the first reject, the rate and the speed-up k r + 1, with quantities as drafts of five."""
    l = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.sum(F.least(F.col("l_quantity").cast("long") % 6, F.lit(5))).alias("accepted"), (F.count(F.lit(1)) * 5).alias("drafted"))
    return l.select("l_linenumber", "accepted", "drafted", F.round(F.col("accepted") / F.col("drafted"), 9).alias("rate"), F.round(5 * F.col("accepted") / F.col("drafted") + 1, 6).alias("speedup"))


def plot_rows(spark: SparkSession, d: str) -> DataFrame:
    """Daily mean values scaled to twelve rows of a plot, between their least and greatest."""
    e = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("value"), 4).alias("v"))
    m = e.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return e.crossJoin(F.broadcast(m)).select(F.unix_timestamp("day").alias("day"), "v", F.coalesce(F.floor(F.try_divide((F.col("v") - F.col("lo")) * 11, F.col("hi") - F.col("lo"))), F.lit(0)).cast("long").alias("row"))


def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user that end after half an hour without events."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


def votes_again(spark: SparkSession, d: str) -> DataFrame:
    """The last verdict before each judge's next one on the same path, and the hours between."""
    w = Window.partitionBy("path_id", "judge").orderBy("judged_at", "verdict")
    v = table(spark, d, "judge_verdicts").where("judged_at is not null").select("path_id", F.lower(F.trim("judge_id")).alias("judge"), "judged_at", F.coalesce("verdict", F.lit("")).alias("verdict")).distinct()
    again = v.withColumn("next", F.lead("judged_at").over(w)).where("next is not null")
    return again.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.unix_micros(F.col("next").cast("timestamp")) - F.unix_micros(F.col("judged_at").cast("timestamp"))) / 3.6e9), 4).alias("mean_hours"))


QUERIES = {f.__name__: f for f in (pairwise_swap, swap_stability, self_preference, truncate_to_shortest, policy_terms, acceptance, plot_rows, user_sessions, votes_again)}

_TWICE = """s AS (SELECT pair_id, diversity_score AS v, row_number() OVER (PARTITION BY pair_id ORDER BY scored_at, diversity_score) AS a, row_number() OVER (PARTITION BY pair_id ORDER BY scored_at DESC, diversity_score DESC) AS b FROM sample_pairs WHERE diversity_score IS NOT NULL AND NOT isnan(diversity_score) AND scored_at IS NOT NULL),
g AS (SELECT pair_id, max(v) FILTER (a = 1) AS f, max(v) FILTER (b = 1) AS r FROM s GROUP BY 1), t AS (SELECT *, CASE WHEN f > 0.6 THEN 'A' WHEN f < 0.4 THEN 'B' ELSE 'TIE' END AS x, CASE WHEN r > 0.6 THEN 'A' WHEN r < 0.4 THEN 'B' ELSE 'TIE' END AS y FROM g)"""
_PATHS = "t AS (SELECT path_id, min(problem_id) AS problem_id, min(generation_metadata.model) AS model, any_value(is_correct) AS ok, any_value(confidence) AS c FROM reasoning_paths GROUP BY 1)"
SQL = {
    "pairwise_swap": f"WITH {_TWICE} SELECT pair_id, CASE WHEN x = y THEN x ELSE 'TIE' END AS winner, round(CASE WHEN x = y THEN (f + r) / 2 ELSE greatest(f, r) / 2 END, 6) AS confidence, x = y AS stable FROM t",
    "swap_stability": f"WITH {_TWICE} SELECT count(*) AS n, count(*) FILTER (x = y) AS n_stable, round(1 - count(*) FILTER (x = y) / count(*), 9) AS swap_rate FROM t",
    "self_preference": f"WITH {_PATHS}, g AS (SELECT model, count(*) AS n, count(*) FILTER (ok) AS k FROM t WHERE model IS NOT NULL AND ok IS NOT NULL GROUP BY 1), a AS (SELECT sum(n) AS tn, sum(k) AS tk FROM g) SELECT model, n, round(k / n - (tk - k) / (tn - n), 9) AS delta FROM g, a",
    "truncate_to_shortest": "WITH p AS (SELECT provenance.pair_id AS pair_id, coalesce(any_value(pair.chosen), '') AS c, coalesce(any_value(pair.rejected), '') AS r FROM dpo_pairs_v1 GROUP BY 1) SELECT pair_id, CAST(least(length(c), length(r)) AS INT) AS n, md5(left(c, least(length(c), length(r)))) AS chosen_md5, md5(left(r, least(length(c), length(r)))) AS rejected_md5 FROM p",
    "policy_terms": f"WITH {_PATHS}, u AS (SELECT *, avg(ln(c)) OVER (PARTITION BY model) AS old FROM t WHERE model IS NOT NULL AND c > 0), v AS (SELECT model, exp(ln(c) - old) AS ratio, CASE WHEN ok THEN 1.0 ELSE -1.0 END::DOUBLE AS adv, exp(old - ln(c)) - (old - ln(c)) - 1 AS k FROM u) SELECT model, count(*) AS n, round(-avg(least(ratio * adv, least(greatest(ratio, 0.8::DOUBLE), 1.2::DOUBLE) * adv)), 5) AS loss, round(avg(k), 5) AS kl FROM v GROUP BY 1",
    "acceptance": "WITH l AS (SELECT l_linenumber, CAST(sum(least(CAST(l_quantity AS BIGINT) % 6, 5)) AS BIGINT) AS accepted, count(*) * 5 AS drafted FROM lineitem GROUP BY 1) SELECT *, round(accepted / drafted, 9) AS rate, round(5 * accepted / drafted + 1, 6) AS speedup FROM l",
    "plot_rows": "WITH e AS (SELECT date_trunc('day', ts) AS day, round(avg(value), 4) AS v FROM events GROUP BY 1), m AS (SELECT min(v) AS lo, max(v) AS hi FROM e) SELECT CAST(epoch(day) AS BIGINT) AS day, v, CAST(coalesce(floor((v - lo) * 11 / nullif(hi - lo, 0)), 0) AS BIGINT) AS row FROM e, m",
    "user_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e), g AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest, CAST(sum(n) AS BIGINT) AS events FROM g GROUP BY 1",
    "votes_again": "WITH v AS (SELECT DISTINCT path_id, lower(trim(judge_id)) AS judge, judged_at, coalesce(verdict, '') AS verdict FROM judge_verdicts WHERE judged_at IS NOT NULL), n AS (SELECT *, lead(judged_at) OVER (PARTITION BY path_id, judge ORDER BY judged_at, verdict) AS nx FROM v) SELECT judge, count(*) AS n, round(avg((epoch_us(nx) - epoch_us(judged_at)) / 3.6e9), 4) AS mean_hours FROM n WHERE nx IS NOT NULL GROUP BY 1",
}
