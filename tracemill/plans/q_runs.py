"""Queries that summarise runs, pick among traces and schedule work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import text as X
from tracemill.operators import search, training, voting
from tracemill.operators.ranking import place_in_group
from tracemill.plans.q_eval import _SCORED, _scored
from tracemill.plans.q_text import _COHERENCE, _FINAL
from tracemill.plans.q_train import _LABELS, _PAIRS, _pairs, _steps
from tracemill.plans.views import TRACES, step_count_sql, words_sql
from tracemill.plans.views import traces as traces_view
from tracemill.runtime import compute_once, dealt, table

#: Longest sequence of tokens for training, the label of what isn't learned, and the stand-in vocabulary.
LONGEST, MASKED, VOCABULARY = 256, -100, 50_000


def _number(key: Column) -> Column:
    """A number from the first eight digits of an MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


# Summaries of runs.


def percentile_index(spark: SparkSession, d: str) -> DataFrame:
    """Per user and kind of event: the values at places n * .95 and n * .99 of the sorted ones, 0 for up to 20 or 100 values, and the greatest."""
    e = place_in_group(table(spark, d, "events").select(F.concat_ws(" ", F.col("user_id") % 40, "event_type").alias("run"), "value", "event_id"), "run", "value", "event_id", place="k", size="n")
    at = lambda p, least: F.when(F.col("n") > least, F.max(F.when(F.col("k") - 1 == F.floor(F.col("n") * p), F.col("value")))).otherwise(0.0)
    return e.groupBy("run", "n").agg(F.round(at(0.95, 20), 4).alias("p95"), F.round(at(0.99, 100), 4).alias("p99"), F.round(F.max("value"), 4).alias("most"))


def throughput_summary(spark: SparkSession, d: str) -> DataFrame:
    """Lines as steps per return flag: sums, rates as ratios of sums, mean and nearest-rank percentile of a step; no time gives rate 0."""
    l = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_tax").cast("double").alias("s"), F.col("l_quantity").cast("double").alias("q"))
    r = place_in_group(l, "l_returnflag", "s", "l_orderkey", "l_linenumber", place="k", size="n")
    p95 = F.max(F.when(F.col("k") - 1 == F.bround(0.95 * (F.col("n") - 1)), F.col("s") * 1000))
    g = r.groupBy(F.col("l_returnflag").alias("stage"), F.col("n").alias("steps")).agg(F.sum("s").alias("wall"), F.sum("q").alias("tokens"), F.avg(F.col("s") * 1000).alias("mean_ms"), p95.alias("p95_ms"))
    rate = lambda x: F.round(F.when(F.col("wall") > 0, x / F.col("wall")).otherwise(0.0), 4)
    return g.select("stage", "steps", F.round("wall", 4).alias("wall_s"), rate(F.col("tokens")).alias("tokens_per_s"), rate(F.col("steps")).alias("steps_per_s"), F.round("mean_ms", 4).alias("mean_ms"), F.round("p95_ms", 4).alias("p95_ms"))


def step_timing(spark: SparkSession, d: str) -> DataFrame:
    """Orders as steps: how much of rolling out and waiting is rolling out, idle time, and tokens a second, guarded against no time."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("double")).alias("roll"), F.sum(F.col("l_tax").cast("double") * 1e5).alias("wait"), F.sum(F.col("l_discount").cast("double") * 1e5).alias("wall"), F.sum(F.col("l_quantity").cast("double")).alias("tokens"))
    overlap = F.col("roll") / F.greatest(F.col("roll") + F.col("wait"), F.lit(1e-6))
    return l.select("l_orderkey", F.round(overlap, 6).alias("overlap"), F.round(F.least("wait", "wall"), 4).alias("idle_ms"), F.round(F.col("tokens") / F.greatest(F.col("wall") / 1000, F.lit(1e-9)), 3).alias("tokens_per_s"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Training logs, with the lines of the orders of a customer's segment as stand-in: loss, margin (0 says nothing) and divergence (likewise)."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("run"))
    l = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    value = lambda c: F.col(c).cast("double")
    return l.select("run", F.struct("l_orderkey", "l_linenumber", value("l_extendedprice"), value("l_discount"), value("l_tax")).alias("step"), F.round(value("l_extendedprice") / 1e4 - 2, 6).alias("loss"), F.round(value("l_discount") - 0.05, 6).alias("margin"), F.round(value("l_tax") * 15, 6).alias("kl"))


def training_log(spark: SparkSession, d: str) -> DataFrame:
    """Per run: first and last loss and how far it fell, last margin and its change, mean and greatest divergence; zeros count as not logged."""
    margin, kl = F.nullif(F.col("margin"), F.lit(0.0)), F.nullif(F.col("kl"), F.lit(0.0))
    met = F.when(F.col("margin") != 0, F.col("step"))
    g = _log(spark, d).groupBy("run").agg(
        F.count(F.lit(1)).alias("steps"), F.min_by("loss", "step").alias("first"), F.max_by("loss", "step").alias("last"), F.min_by(margin, met).alias("m0"), F.max_by(margin, met).alias("m1"), F.avg(kl).alias("mean_kl"), F.max(kl).alias("most_kl"),
    )
    fell = F.when(F.col("steps") > 1, F.col("first") - F.col("last")).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select("run", "steps", "first", "last", F.round(fell, 6).alias("reduction"), F.round(zero(F.try_divide(fell * 100, F.col("first"))), 4).alias("reduction_pct"), F.round(zero(F.col("m1")), 6).alias("margin"), F.round(zero(F.col("m1") - F.col("m0")), 6).alias("margin_change"), F.round(zero(F.col("mean_kl")), 5).alias("mean_kl"), F.round(zero(F.col("most_kl")), 6).alias("most_kl"))


def training_health(spark: SparkSession, d: str) -> DataFrame:
    """What the summary of a run says about its loss, margin and divergence.

    A loss below 0 on either end should fall further; else falling by more than
    10 % is good. Margins should be above 0; divergence is bounded below .5 and
    moderate below 1.
    """
    s = training_log(spark, d)
    negative = (F.col("first") < 0) | (F.col("last") < 0)
    loss = F.when(negative, F.when(F.col("last") < F.col("first"), "improving").otherwise("stuck")).when(F.col("reduction_pct") > 10, "improving").when(F.col("reduction_pct") > 0, "slow").otherwise("stuck")
    margin = F.when(F.col("margin") > 0, "good").when(F.col("margin") < 0, "bad").otherwise("none")
    kl = F.when(F.col("most_kl") < 0.5, "bounded").when(F.col("most_kl") < 1.0, "moderate").otherwise("high")
    return s.select("run", loss.alias("loss"), margin.alias("margin"), kl.alias("kl"))


def plot_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Hourly means of the events scaled to fifteen rows; of more than sixty every (n // 60)-th, the first sixty."""
    e = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.avg("value"), 4).alias("v"))
    p = place_in_group(e.select(F.lit(1).alias("g"), "hour", "v"), "g", "hour", place="k", size="n")
    m = p.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = F.when(F.col("n") > 60, F.floor(F.col("n") / 60)).otherwise(1)
    row = F.floor((F.col("v") - F.col("lo")) / F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo")) * 14)
    return p.crossJoin(F.broadcast(m)).where(((F.col("k") - 1) % step == 0) & ((F.col("k") - 1) / step < 60)).select(F.unix_timestamp("hour").alias("hour"), "v", row.cast("long").alias("row"))


def verify_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per backend: traces by status, the share that passed, and a histogram of ten bins of the time they took."""
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.min("generation_metadata.backend").alias("backend"), F.first("is_correct").alias("ok"), F.min(F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("generated_at").cast("timestamp"))).alias("us"))
    w = t.groupBy("backend").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    j = t.join(w, "backend")
    bin_ = F.least(F.lit(9), F.floor(F.coalesce(F.try_divide((F.col("us") - F.col("lo")) * 10.0, F.col("hi") - F.col("lo")), F.lit(0.0))))
    return j.groupBy("backend", bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"), F.count_if(F.col("ok").isNull()).alias("unknown"), F.round(F.count_if("ok") / F.count(F.lit(1)), 9).alias("pass_rate"))


def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    """Traces in eight contiguous chunks in order of arrival, as workers would take them, with what each processed."""
    t = traces_view(spark, d, once=False).select("ord", F.length("reasoning").alias("n"), F.col("is_correct").alias("ok")).dropDuplicates(["ord"]).withColumn("g", F.lit(1))
    p = place_in_group(t, "g", "ord", place="k", size="m")
    return p.groupBy(F.floor((F.col("k") - 1) * 8 / F.col("m")).cast("int").alias("chunk")).agg(F.count(F.lit(1)).alias("processed"), F.sum("n").alias("n_chars"), F.count_if("ok").alias("passed"))


def suite_status(spark: SparkSession, d: str) -> DataFrame:
    """Benchmarks by source with accuracy, mean seconds and success rate, and the status of each and of the whole suite."""
    p = table(spark, d, "problems").select(F.col("id").alias("problem_id"), "source_dataset")
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.min("problem_id").alias("problem_id"), F.first("is_correct").alias("ok"), F.min(F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("generated_at").cast("timestamp"))).alias("us"))
    r = t.join(p, "problem_id").groupBy("source_dataset").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("correct"), F.count("ok").alias("judged"), F.round(F.avg("us") / 1e6, 3).alias("mean_s"))
    status = F.when(F.col("judged") == F.col("total"), "success").when(F.col("judged") > 0, "partial").otherwise("failed")
    r = r.select("source_dataset", "total", "correct", F.round(F.col("correct") / F.col("total"), 9).alias("accuracy"), F.round(F.col("judged") / F.col("total"), 9).alias("success_rate"), "mean_s", status.alias("status"))
    suite = r.agg(F.when(F.count_if(F.col("status") == "success") == F.count(F.lit(1)), "success").when(F.count_if(F.col("status") == "failed") == F.count(F.lit(1)), "failed").otherwise("partial").alias("suite"))
    return r.crossJoin(F.broadcast(suite))


# Metrics of models and pairs.


def model_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per model: problems, pass@1, @4 and @8 in order of arrival, mean reward, length and steps."""
    t = traces_view(spark, d, once=False).where("model is not null").select("model", "problem_id", "ord", "is_correct", F.length("reasoning").alias("n"), X.step_count(F.col("reasoning")).alias("steps")).dropDuplicates(["ord"])
    k = F.row_number().over(Window.partitionBy("model", "problem_id").orderBy("ord"))
    first = t.withColumn("k", k).where("k <= 8").groupBy("model", "problem_id").agg(F.min(F.when(F.col("is_correct"), F.col("k"))).alias("first"))
    passed = first.groupBy("model").agg(F.count(F.lit(1)).alias("problems"), *(F.round(F.count_if(F.col("first") <= n) / F.count(F.lit(1)), 9).alias(f"pass_at_{n}") for n in (1, 4, 8)))
    means = t.groupBy("model").agg(F.round(F.avg(F.col("is_correct").cast("int")), 9).alias("mean_reward"), F.round(F.avg("n"), 5).alias("mean_length"), F.round(F.avg("steps"), 6).alias("mean_steps"))
    return passed.join(means, "model")


def model_delta(spark: SparkSession, d: str) -> DataFrame:
    """Every model's metrics less those of the first by name."""
    m = model_metrics(spark, d)
    cols = ("pass_at_1", "pass_at_4", "pass_at_8", "mean_reward")
    base = m.agg(F.min_by(F.struct("model", *cols), "model").alias("b"))
    return m.crossJoin(F.broadcast(base)).where("model != b.model").select("model", *(F.round(F.col(c) - F.col(f"b.{c}"), 8).alias(c) for c in cols))


def heldout_history(spark: SparkSession, d: str) -> DataFrame:
    """Per day as a checkpoint: pass@1 and mean reward of the first trace of each held-out problem, in order."""
    p = table(spark, d, "problems").where("source_split = 'test'").select(F.col("id").alias("problem_id"))
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.min("problem_id").alias("problem_id"), F.coalesce(F.first("is_correct"), F.lit(False)).alias("ok"), F.min("generated_at").alias("at")).where("at is not null").join(p, "problem_id")
    first = t.groupBy(F.date_trunc("day", F.col("at").cast("timestamp")).alias("day"), "problem_id").agg(F.min_by("ok", "path_id").alias("ok"))
    g = first.groupBy("day").agg(F.count(F.lit(1)).alias("problems"), F.count_if("ok").alias("correct"), F.round(F.avg(F.col("ok").cast("double")), 9).alias("mean_reward"))
    return g.select(F.row_number().over(Window.orderBy("day")).alias("step"), F.unix_timestamp("day").alias("day"), "problems", "correct", "mean_reward")


def pair_margins(spark: SparkSession, d: str) -> DataFrame:
    """Margins of pairs by the heuristic score of either side: per split, mean margin and how often the chosen side is ahead."""
    p = table(spark, d, "dpo_pairs_v1").select(F.col("provenance.pair_id").alias("ord"), F.lower(F.trim("provenance.source_split")).alias("split"), F.coalesce("pair.chosen", F.lit("")).alias("c"), F.coalesce("pair.rejected", F.lit("")).alias("r"))
    s = compute_once(dealt(p, d, "dpo_pairs_v1"), {"cw": X.words(F.col("c")), "rw": X.words(F.col("r")), "ca": A.vote_answer(F.col("c")), "ra": A.vote_answer(F.col("r"))})
    m = s.select("ord", "split", F.round(X.heuristic_score(F.col("cw"), F.col("ca")) - X.heuristic_score(F.col("rw"), F.col("ra")), 6).alias("margin")).dropDuplicates(["ord"])
    return m.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("margin"), 5).alias("mean_margin"), F.count_if(F.col("margin") > 0).alias("ahead"))


def step_pairs_by_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Right steps joined with wrong ones of the same prompt and place, whichever pair they come from; steps are counted, not listed."""
    prompts = _pairs(spark, d).select(F.col("ord").alias("key"), F.md5("prompt").alias("prompt"))
    s = training.step_labels(_steps(spark, d)).join(prompts, "key").where("prompt is not null").groupBy("prompt", "i").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    return s.where("good > 0 and bad > 0").groupBy("i").agg(F.sum(F.col("good") * F.col("bad")).alias("n"), F.count(F.lit(1)).alias("prompts"))


def dpo_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Prompt and chosen text as token ids, cut at LONGEST, with labels that mask the prompt; words stand in for tokens."""
    p = table(spark, d, "dpo_pairs_v1").select(F.col("provenance.pair_id").alias("ord"), F.coalesce("pair.prompt", F.lit("")).alias("p"), F.coalesce("pair.chosen", F.lit("")).alias("c"))
    ids = lambda c: F.transform(X.words(F.col(c)), lambda w: _number(w) % VOCABULARY)
    t = compute_once(dealt(p, d, "dpo_pairs_v1"), {"pi": ids("p"), "ci": ids("c")})
    cut = lambda a: F.slice(a, 1, LONGEST)
    labels = F.concat(F.transform("pi", lambda x: F.lit(MASKED).cast("long")), "ci")
    return t.select("ord", F.size(cut(F.concat("pi", "ci"))).alias("n_tokens"), F.least(F.size("pi"), F.lit(LONGEST)).alias("n_masked"), F.md5(F.array_join(cut(F.concat("pi", "ci")), ",")).alias("ids_md5"), F.md5(F.array_join(cut(labels), ",")).alias("labels_md5")).dropDuplicates(["ord"])


def chat_few_shot(spark: SparkSession, d: str) -> DataFrame:
    """Problems as a chat of role and content lines with the first two evaluation items as examples, and the opening of an answer."""
    shots = table(spark, d, "eval_items").orderBy("item_id").limit(2).agg(F.array_sort(F.collect_list(F.struct("item_id", "item_text", "answer"))).alias("shots"))
    line = lambda role, text: F.concat(F.lit(f"<|{role}|>\n"), F.coalesce(text, F.lit("")))
    system = F.when(F.col("entry_point").isNotNull(), "You write correct code.").otherwise("You reason step by step.")
    turns = F.flatten(F.transform("shots", lambda s: F.array(line("user", s["item_text"]), line("assistant", s["answer"]))))
    chat = F.array_join(F.concat(F.array(line("system", system)), turns, F.array(line("user", F.col("problem")), F.lit("<|assistant|>\n"))), "\n")
    return table(spark, d, "problems").crossJoin(F.broadcast(shots)).select("id", F.md5(chat).alias("chat_md5"), F.length(chat).alias("n_chars"))


def engine_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The plain prompt of each problem for an engine without chat, for words or code."""
    text = F.coalesce("problem", F.lit(""))
    prompt = F.when(F.col("entry_point").isNotNull(), F.concat(F.lit("Task: "), text, F.lit("\nWrite the function "), "entry_point", F.lit(".\n```python\n"))).otherwise(F.concat(F.lit("Problem: "), text, F.lit("\nReason in steps and end with ####.\n")))
    return table(spark, d, "problems").select("id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).alias("n_chars"))


# Picking and search.


def first_problems(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty problems in order of id."""
    return table(spark, d, "problems").orderBy("id").limit(50).select("id", "source_dataset")


def sorted_results(spark: SparkSession, d: str) -> DataFrame:
    """pass@k in order of k, with the place of each row."""
    return voting.pass_at(traces_view(spark, d, once=False).select("problem_id", "ord", "is_correct").dropDuplicates(["ord"]), (8, 1, 4, 2)).withColumn("place", F.row_number().over(Window.orderBy("k"))).select("place", "k", "passed", "rate")


def expected_answers(spark: SparkSession, d: str) -> DataFrame:
    """Per prompt: the given answer, the answer of its first chosen text that has one, and the first of both that is there; every third prompt counts as if none were given."""
    p = _pairs(spark, d).where("prompt is not null and prompt != ''")
    x = A.with_final_answer(p.select("ord", F.md5("prompt").alias("prompt_md5"), "expected", "chosen"), "chosen", "a", "m")
    given = F.when(_number(F.col("prompt_md5")) % 3 != 0, F.min_by("expected", F.when(F.nullif("expected", F.lit("")).isNotNull(), F.col("ord"))))
    g = x.groupBy("prompt_md5").agg(given.alias("given"), F.min_by("a", F.when(F.nullif("a", F.lit("")).isNotNull(), F.col("ord"))).alias("fallback"))
    return g.select("prompt_md5", "given", "fallback", F.coalesce("given", "fallback").alias("resolved"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    t = traces_view(spark, d, once=False).select("ord", "problem_id", "is_correct", "confidence", X.step_coherence(F.col("reasoning")).alias("steps")).dropDuplicates(["ord"])
    modes = F.array(F.struct(F.lit("outcome").alias("mode"), F.round("confidence", 6).alias("score")), F.struct(F.lit("process").alias("mode"), F.round("steps", 6).alias("score")))
    t = t.select("ord", "problem_id", "is_correct", F.inline(modes))
    return t.groupBy("mode", "problem_id").agg(F.max_by(F.struct("ord", "is_correct"), F.struct("score", -F.col("ord"))).alias("best"), F.max("score").alias("score"))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """The best trace of each problem by outcome (its confidence stands in) and by process (the mean of its steps), the first on ties."""
    return _ranked(spark, d).select("mode", "problem_id", F.col("best.ord").alias("ord"), "score")


def rerank_modes(spark: SparkSession, d: str) -> DataFrame:
    """How many problems each way of ranking solves."""
    return _ranked(spark, d).groupBy("mode").agg(F.count(F.lit(1)).alias("problems"), F.count_if("best.is_correct").alias("solved"), F.round(F.count_if("best.is_correct") / F.count(F.lit(1)), 9).alias("accuracy"))


def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """Per run of hourly scores: best score and step when a patience of six evaluations runs out, and the step where it did (null if it never does)."""
    h = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("run"), F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("score"))
    return training.best_checkpoint(h.select("run", F.unix_timestamp("day").alias("step"), "score"), 0.5, patience=6)


def first_verified(spark: SparkSession, d: str) -> DataFrame:
    """Per problem, the first verified trace of its first five; null if none is."""
    t = voting.sample_index(traces_view(spark, d, once=False).select("ord", "problem_id", "is_correct", F.md5("reasoning").alias("h")).dropDuplicates(["ord"]), 5)
    return t.groupBy("problem_id").agg(F.min_by("h", F.when(F.col("is_correct"), F.col("k"))).alias("solution_md5"))


def rejected_choice(spark: SparkSession, d: str) -> DataFrame:
    """Per problem, the first trace whose marked number isn't the gold one; without any, a text with the gold number and seven."""
    number = lambda c: A.last_match(F.regexp_replace(c, "[,$]", ""), r"(-?\d+\.?\d*)").cast("double")
    p = table(spark, d, "problems").select(F.col("id").alias("problem_id"), number(F.coalesce("answer", F.lit(""))).alias("g"))
    said = F.nullif(A.last_match(F.col("reasoning"), r"####\s*(-?\d+\.?\d*)"), F.lit("")).cast("double")
    t = traces_view(spark, d, once=False).select("ord", "problem_id", said.alias("a"), F.md5("reasoning").alias("h")).dropDuplicates(["ord"])
    wrong = p.join(t, "problem_id", "left").groupBy("problem_id", "g").agg(F.min_by("h", F.when(F.abs(F.col("a") - F.col("g")) > 0.01, F.col("ord"))).alias("h"))
    made = F.concat(F.lit("Step by step, the answer is "), F.coalesce((F.col("g") + 7).cast("long"), F.lit(999)).cast("string"), F.lit("."))
    return wrong.select("problem_id", F.coalesce("h", F.md5(made)).alias("rejected_md5"), F.col("h").isNull().alias("made"))


def acceptance_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Drafted tokens taken one after another with chance min(1, p / q) until the first that is not; lines of an order stand in for the draft."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount").cast("double") + 0.03).alias("p"), (F.col("l_tax").cast("double") + 0.05).alias("q"))
    u = _number(F.concat_ws(":", "l_orderkey", "l_linenumber")) / F.lit(4294967296.0)
    l = l.withColumn("ok", u < F.least(F.lit(1.0), F.col("p") / F.col("q")))
    g = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("drafted"), F.min(F.when(~F.col("ok"), F.col("l_linenumber"))).alias("stop"), F.array_sort(F.collect_list("l_linenumber")).alias("places"))
    taken = F.size(F.filter("places", lambda n: F.col("stop").isNull() | (n < F.col("stop"))))
    return g.select("l_orderkey", "drafted", taken.alias("accepted"), F.round(taken / F.col("drafted"), 9).alias("rate"))


def _continuations(problem: Column, text: Column) -> Column:
    """Three stand-in continuations of a partial text, one of which may end it."""
    n = _number(F.concat_ws("|", problem, text))
    return F.array(F.concat(F.lit("a"), (n % 7).cast("string")), F.concat(F.lit("b"), F.repeat(F.lit("."), (n % 5).cast("int"))), F.when(n % 4 == 0, "#### 7").otherwise(F.concat(F.lit("c"), (n % 3).cast("string"))))


def beam_search(spark: SparkSession, d: str) -> DataFrame:
    """A beam of two over all problems at once, three steps deep, with stand-in continuations."""
    return search.beam_frame(table(spark, d, "problems").select(F.col("id").alias("problem_id")), _continuations, width=2, steps=3)


def oracle_rerank(spark: SparkSession, d: str) -> DataFrame:
    """For analysis only, as it knows the gold answer: the best trace of each problem by its heuristic score and ten points if it is correct."""
    s = _scored(spark, d).withColumn("score", F.round(F.col("score") + F.when(F.col("is_correct"), 10.0).otherwise(0.0), 6))
    return voting.best_of(s)


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """A seeded four fifths of the pairs for training, by a hash of their ids, so that it stays the same when pairs come in."""
    p = table(spark, d, "dpo_pairs_v1").select(F.col("provenance.pair_id").alias("pair_id"), F.lower(F.trim("provenance.source_dataset")).alias("source")).where("pair_id is not null").dropDuplicates(["pair_id"])
    return p.select("pair_id", F.when(_number(F.concat("pair_id", F.lit(":42"))) % 5 < 4, "train").otherwise("eval").alias("part"))


def run_diff(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the last day of generation against the day before, by backend; only backends that both have."""
    t = table(spark, d, "reasoning_paths").groupBy("path_id").agg(F.min("generation_metadata.backend").alias("backend"), F.first("is_correct").alias("ok"), F.min("generated_at").alias("at")).where("at is not null")
    r = t.groupBy(F.date_trunc("day", F.col("at").cast("timestamp")).alias("day"), "backend").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("correct"))
    days = r.select("day").distinct().orderBy(F.col("day").desc()).limit(2)
    days = days.withColumn("k", F.row_number().over(Window.orderBy(F.col("day").desc())))
    j = r.join(F.broadcast(days), "day")
    a, b = j.where("k = 1").select("backend", F.col("n").alias("current"), F.col("correct").alias("c")), j.where("k = 2").select("backend", F.col("n").alias("previous"), F.col("correct").alias("p"))
    return a.join(b, "backend").select("backend", "current", "previous", (F.col("current") - F.col("previous")).alias("delta"), (F.col("c") - F.col("p")).alias("correct_delta"))


def rejection_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of rejection sampling: each takes a third of the problems by a hash of problem and round, and from each its first correct trace not taken in a round before."""
    t = traces_view(spark, d, once=False).where("is_correct").select("problem_id", "ord").dropDuplicates(["ord"])
    t = voting.sample_index(t, 3)
    drawn = None
    for r in range(3):
        one = t.select("problem_id").distinct().where(_number(F.concat_ws(":", "problem_id", F.lit(str(r)))) % 3 == 0).withColumn("round", F.lit(r))
        drawn = one if drawn is None else drawn.unionAll(one)
    # The n-th round that draws a problem takes its n-th correct trace.
    turn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("problem_id").orderBy("round")) - 1)
    return turn.join(t, ["problem_id", "k"]).select("round", "problem_id", "ord")


def problem_types(spark: SparkSession, d: str) -> DataFrame:
    """Problems per source by kind: code if they name a function, else math."""
    kind = F.when(F.col("entry_point").isNotNull(), "code").otherwise("math")
    return table(spark, d, "problems").groupBy("source_dataset", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        percentile_index, throughput_summary, step_timing, training_log, training_health, plot_sampled, verify_stats, chunk_totals, suite_status, model_metrics, model_delta, heldout_history, pair_margins, step_pairs_by_prompt, dpo_tokens, chat_few_shot,
        engine_prompts, first_problems, sorted_results, expected_answers, reranked, rerank_modes, early_stop, first_verified, rejected_choice, acceptance_sampling, beam_search, oracle_rerank, hash_split, run_diff, rejection_rounds, problem_types,
    )
}

_P = "paths AS (SELECT path_id, min(problem_id) AS problem_id, min(generation_metadata.model) AS model, min(generation_metadata.backend) AS backend, any_value(is_correct) AS ok, any_value(reasoning) AS reasoning, min(epoch_us(ingested_at) - epoch_us(generated_at)) AS us, min(generated_at) AS made FROM reasoning_paths GROUP BY 1)"
_LOG = "lg AS (SELECT o_custkey % 25 AS run, row_number() OVER (ORDER BY l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE)) AS step, round(CAST(l_extendedprice AS DOUBLE) / 1e4 - 2, 6) AS loss, round(CAST(l_discount AS DOUBLE) - 0.05, 6) AS margin, round(CAST(l_tax AS DOUBLE) * 15, 6) AS kl FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_SUMMARY = f"""{_LOG}, g AS (SELECT run, count(*) AS steps, arg_min(loss, step) AS first, arg_max(loss, step) AS last, arg_min(margin, step) FILTER (margin <> 0) AS m0, arg_max(margin, step) FILTER (margin <> 0) AS m1, avg(kl) FILTER (kl <> 0) AS mk, max(kl) FILTER (kl <> 0) AS xk FROM lg GROUP BY 1),
summary AS (SELECT run, steps, first, last, round(CASE WHEN steps > 1 THEN first - last ELSE 0.0 END, 6) AS reduction, round(coalesce(CASE WHEN steps > 1 THEN first - last ELSE 0.0 END * 100 / nullif(first, 0), 0.0), 4) AS reduction_pct, round(coalesce(m1, 0.0), 6) AS margin, round(coalesce(m1 - m0, 0.0), 6) AS margin_change, round(coalesce(mk, 0.0), 5) AS mean_kl, round(coalesce(xk, 0.0), 6) AS most_kl FROM g)"""
_METRICS = f"""{TRACES}, tm AS (SELECT *, row_number() OVER (PARTITION BY model, problem_id ORDER BY ord) AS k FROM traces WHERE model IS NOT NULL), fm AS (SELECT model, problem_id, min(k) FILTER (is_correct AND k <= 8) AS first FROM tm GROUP BY 1, 2),
pm AS (SELECT model, count(*) AS problems, round(count(*) FILTER (first <= 1) / count(*), 9) AS pass_at_1, round(count(*) FILTER (first <= 4) / count(*), 9) AS pass_at_4, round(count(*) FILTER (first <= 8) / count(*), 9) AS pass_at_8 FROM fm GROUP BY 1),
am AS (SELECT model, round(avg(CAST(is_correct AS INT)), 9) AS mean_reward, round(avg(length(reasoning)), 5) AS mean_length, round(avg({step_count_sql("reasoning")}), 6) AS mean_steps FROM tm GROUP BY 1), metrics AS (SELECT * FROM pm JOIN am USING (model))"""
_HASH = lambda k: f"CAST('0x' || left(md5({k}), 8) AS BIGINT)"
_IDS = lambda c: f"list_transform({words_sql(c)}, lambda w: CAST('0x' || left(md5(w), 8) AS BIGINT) % {VOCABULARY})"
_SCORE = lambda w, a: f"(CASE WHEN {a} IS NOT NULL THEN 0.5 ELSE 0.0 END + least(len({w}) / 400.0, 0.35) - CASE WHEN len({w}) < 20 THEN 0.0 ELSE greatest(0.0, 0.55 - len(list_distinct({w})) / len({w})) END)"
_VOTED = lambda c: rf"replace(coalesce(list_last(regexp_extract_all({c}, '####\s*(-?[\d,]+(?:\.\d+)?)', 1)), list_last(regexp_extract_all({c}, '(?i)answer is[:\s]*\$?(-?[\d,]+(?:\.\d+)?)', 1))), ',', '')"
_RANKED = f"""{TRACES}, rk AS (SELECT ord, problem_id, is_correct, unnest([{{'mode': 'outcome', 'score': round(confidence, 6)}}, {{'mode': 'process', 'score': round({_COHERENCE.replace("@x@", "reasoning")}, 6)}}], recursive := true) FROM traces), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mode, problem_id ORDER BY score DESC, ord) AS k FROM rk) WHERE k = 1)"""
_NEXT = "[{'t': 'a' || (n % 7)}, {'t': 'b' || repeat('.', CAST(n % 5 AS INT))}, {'t': CASE WHEN n % 4 = 0 THEN '#### 7' ELSE 'c' || (n % 3) END}]"


def _beam_sql(steps: int, width: int) -> str:
    ctes = ["b0 AS (SELECT id AS problem_id, 0.0::DOUBLE AS score, '' AS text, false AS done FROM problems)"]
    ended = "contains({t}, '####') OR contains(lower({t}), 'answer is')"
    for k in range(1, steps + 1):
        ctes.append(f"e{k} AS (SELECT problem_id, score, text, unnest(list_transform({_NEXT}, lambda s: s.t)) AS more FROM (SELECT *, {_HASH("problem_id || '|' || text")} AS n FROM b{k - 1} WHERE NOT done))")
        ctes.append(f"g{k} AS (SELECT problem_id, round(score + CASE WHEN {ended.format(t='more')} THEN 10.0 ELSE 0.0 END - length(more) * 0.001, 6) AS score, text || more AS text FROM e{k})")
        ctes.append(f"t{k} AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, text) AS place FROM g{k})")
        ctes.append(f"b{k} AS (SELECT problem_id, score, text, bool_or(place = 1 AND ({ended.format(t='text')})) OVER (PARTITION BY problem_id) AS done FROM t{k} WHERE place <= {width} UNION ALL SELECT problem_id, score, text, done FROM b{k - 1} WHERE done)")
    return f"WITH {', '.join(ctes)} SELECT problem_id, text, score, done FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, text) AS k FROM b{steps}) WHERE k = 1"


SQL = {
    "percentile_index": "WITH e AS (SELECT (user_id % 40) || ' ' || event_type AS run, value, row_number() OVER (PARTITION BY (user_id % 40) || ' ' || event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY (user_id % 40) || ' ' || event_type) AS n FROM events) SELECT run, n, round(CASE WHEN n > 20 THEN max(value) FILTER (k - 1 = floor(n * 0.95::DOUBLE)) ELSE 0.0 END, 4) AS p95, round(CASE WHEN n > 100 THEN max(value) FILTER (k - 1 = floor(n * 0.99::DOUBLE)) ELSE 0.0 END, 4) AS p99, round(max(value), 4) AS most FROM e GROUP BY 1, 2",
    "throughput_summary": "WITH l AS (SELECT l_returnflag AS stage, CAST(l_tax AS DOUBLE) AS s, CAST(l_quantity AS DOUBLE) AS q, row_number() OVER (PARTITION BY l_returnflag ORDER BY CAST(l_tax AS DOUBLE), l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), g AS (SELECT stage, n AS steps, sum(s) AS w, sum(q) AS t, avg(s * 1000) AS m, max(s * 1000) FILTER (k - 1 = round_even(0.95 * (n - 1), 0)) AS p FROM l GROUP BY 1, 2) SELECT stage, steps, round(w, 4) AS wall_s, round(CASE WHEN w > 0 THEN t / w ELSE 0.0 END, 4) AS tokens_per_s, round(CASE WHEN w > 0 THEN steps / w ELSE 0.0 END, 4) AS steps_per_s, round(m, 4) AS mean_ms, round(p, 4) AS p95_ms FROM g",
    "step_timing": "WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DOUBLE)) AS r, sum(CAST(l_tax AS DOUBLE) * 1e5) AS w, sum(CAST(l_discount AS DOUBLE) * 1e5) AS x, sum(CAST(l_quantity AS DOUBLE)) AS t FROM lineitem GROUP BY 1) SELECT l_orderkey, round(r / greatest(r + w, 1e-6), 6) AS overlap, round(least(w, x), 4) AS idle_ms, round(t / greatest(x / 1000, 1e-9), 3) AS tokens_per_s FROM l",
    "training_log": f"WITH {_SUMMARY} SELECT * FROM summary",
    "training_health": f"WITH {_SUMMARY} SELECT run, CASE WHEN first < 0 OR last < 0 THEN CASE WHEN last < first THEN 'improving' ELSE 'stuck' END WHEN reduction_pct > 10 THEN 'improving' WHEN reduction_pct > 0 THEN 'slow' ELSE 'stuck' END AS loss, CASE WHEN margin > 0 THEN 'good' WHEN margin < 0 THEN 'bad' ELSE 'none' END AS margin, CASE WHEN most_kl < 0.5 THEN 'bounded' WHEN most_kl < 1.0 THEN 'moderate' ELSE 'high' END AS kl FROM summary",
    "plot_sampled": "WITH e AS (SELECT date_trunc('hour', ts) AS hour, round(avg(value), 4) AS v FROM events GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY hour) - 1 AS k, count(*) OVER () AS n, min(v) OVER () AS lo, max(v) OVER () AS hi FROM e), s AS (SELECT *, CASE WHEN n > 60 THEN n // 60 ELSE 1 END AS step FROM p) SELECT CAST(epoch(hour) AS BIGINT) AS hour, v, CAST(floor((v - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END * 14) AS BIGINT) AS row FROM s WHERE k % step = 0 AND k / step < 60",
    "verify_stats": f"WITH {_P}, w AS (SELECT backend, min(us) AS lo, max(us) AS hi FROM paths GROUP BY 1), b AS (SELECT backend, CAST(least(9, floor(coalesce((us - lo) * 10.0 / nullif(hi - lo, 0), 0.0))) AS INT) AS bin, ok FROM paths JOIN w USING (backend)) SELECT backend, bin, count(*) AS n, count(*) FILTER (ok) AS passed, count(*) FILTER (ok IS NULL) AS unknown, round(count(*) FILTER (ok) / count(*), 9) AS pass_rate FROM b GROUP BY 1, 2",
    "chunk_totals": f"WITH {TRACES}, k AS (SELECT length(reasoning) AS n, is_correct AS ok, CAST(floor((row_number() OVER (ORDER BY ord) - 1) * 8 / count(*) OVER ()) AS INT) AS chunk FROM traces) SELECT chunk, count(*) AS processed, CAST(sum(n) AS BIGINT) AS n_chars, count(*) FILTER (ok) AS passed FROM k GROUP BY 1",
    "suite_status": f"WITH {_P}, r AS (SELECT source_dataset, count(*) AS total, count(*) FILTER (ok) AS correct, count(ok) AS judged, round(avg(us) / 1e6, 3) AS mean_s FROM paths JOIN problems p ON p.id = problem_id GROUP BY 1), s AS (SELECT source_dataset, total, correct, round(correct / total, 9) AS accuracy, round(judged / total, 9) AS success_rate, mean_s, CASE WHEN judged = total THEN 'success' WHEN judged > 0 THEN 'partial' ELSE 'failed' END AS status FROM r) SELECT *, (SELECT CASE WHEN bool_and(status = 'success') THEN 'success' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END FROM s) AS suite FROM s",
    "model_metrics": f"WITH {_METRICS} SELECT * FROM metrics",
    "model_delta": f"WITH {_METRICS}, b AS (SELECT * FROM metrics ORDER BY model LIMIT 1) SELECT m.model, round(m.pass_at_1 - b.pass_at_1, 8) AS pass_at_1, round(m.pass_at_4 - b.pass_at_4, 8) AS pass_at_4, round(m.pass_at_8 - b.pass_at_8, 8) AS pass_at_8, round(m.mean_reward - b.mean_reward, 8) AS mean_reward FROM metrics m, b WHERE m.model <> b.model",
    "heldout_history": f"WITH {_P}, t AS (SELECT date_trunc('day', made) AS day, problem_id, arg_min(coalesce(ok, false), path_id) AS ok FROM paths JOIN problems p ON p.id = problem_id WHERE source_split = 'test' AND made IS NOT NULL GROUP BY 1, 2), g AS (SELECT day, count(*) AS problems, count(*) FILTER (ok) AS correct, round(avg(CAST(ok AS INT)), 9) AS mean_reward FROM t GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY day) AS INT) AS step, CAST(epoch(day) AS BIGINT) AS day, problems, correct, mean_reward FROM g",
    "pair_margins": f"WITH p AS (SELECT provenance.pair_id AS ord, any_value(lower(trim(provenance.source_split))) AS split, coalesce(any_value(pair.chosen), '') AS c, coalesce(any_value(pair.rejected), '') AS r FROM dpo_pairs_v1 GROUP BY 1), s AS MATERIALIZED (SELECT split, {words_sql('c')} AS cw, {words_sql('r')} AS rw, {_VOTED('c')} AS ca, {_VOTED('r')} AS ra FROM p), m AS (SELECT split, round({_SCORE('cw', 'ca')} - {_SCORE('rw', 'ra')}, 6) AS m FROM s) SELECT split, count(*) AS n, round(avg(m), 5) AS mean_margin, count(*) FILTER (m > 0) AS ahead FROM m GROUP BY 1",
    "step_pairs_by_prompt": f"WITH {_PAIRS}, {_LABELS}, s AS (SELECT prompt, i, count(*) FILTER (label = 1) AS good, count(*) FILTER (label = 0) AS bad FROM labels JOIN prs ON prs.ord = labels.key WHERE prompt IS NOT NULL GROUP BY 1, 2) SELECT i, CAST(sum(good * bad) AS BIGINT) AS n, count(*) AS prompts FROM s WHERE good > 0 AND bad > 0 GROUP BY 1",
    "dpo_tokens": f"WITH p AS (SELECT provenance.pair_id AS ord, coalesce(any_value(pair.prompt), '') AS p, coalesce(any_value(pair.chosen), '') AS c FROM dpo_pairs_v1 GROUP BY 1), t AS MATERIALIZED (SELECT ord, {_IDS('p')} AS pi, {_IDS('c')} AS ci FROM p) SELECT ord, len(list_concat(pi, ci)[1:{LONGEST}]) AS n_tokens, least(len(pi), {LONGEST}) AS n_masked, md5(array_to_string(list_concat(pi, ci)[1:{LONGEST}], ',')) AS ids_md5, md5(array_to_string(list_concat(list_transform(pi, lambda x: CAST({MASKED} AS BIGINT)), ci)[1:{LONGEST}], ',')) AS labels_md5 FROM t",
    "chat_few_shot": "WITH s AS (SELECT string_agg('<|user|>' || chr(10) || coalesce(item_text, '') || chr(10) || '<|assistant|>' || chr(10) || coalesce(answer, ''), chr(10) ORDER BY item_id) AS shots FROM (SELECT * FROM eval_items ORDER BY item_id LIMIT 2)), c AS (SELECT id, '<|system|>' || chr(10) || CASE WHEN entry_point IS NOT NULL THEN 'You write correct code.' ELSE 'You reason step by step.' END || chr(10) || shots || chr(10) || '<|user|>' || chr(10) || coalesce(problem, '') || chr(10) || '<|assistant|>' || chr(10) AS c FROM problems, s) SELECT id, md5(c) AS chat_md5, length(c) AS n_chars FROM c",
    "engine_prompts": "WITH c AS (SELECT id, CASE WHEN entry_point IS NOT NULL THEN 'Task: ' || coalesce(problem, '') || chr(10) || 'Write the function ' || entry_point || '.' || chr(10) || '```python' || chr(10) ELSE 'Problem: ' || coalesce(problem, '') || chr(10) || 'Reason in steps and end with ####.' || chr(10) END AS c FROM problems) SELECT id, md5(c) AS prompt_md5, length(c) AS n_chars FROM c",
    "first_problems": "SELECT id, source_dataset FROM problems ORDER BY id LIMIT 50",
    "sorted_results": f"WITH {TRACES}, i AS (SELECT problem_id, is_correct, row_number() OVER (PARTITION BY problem_id ORDER BY ord) - 1 AS k FROM traces), f AS (SELECT problem_id, min(k) FILTER (is_correct) AS first FROM i GROUP BY 1), g AS (SELECT v.k, count(*) FILTER (first < v.k) AS passed, round(count(*) FILTER (first < v.k) / count(*), 9) AS rate FROM f, (VALUES (1), (2), (4), (8)) v(k) GROUP BY 1) SELECT row_number() OVER (ORDER BY k) AS place, k, passed, rate FROM g",
    "expected_answers": f"WITH {_PAIRS}, c AS (SELECT ord, md5(prompt) AS prompt_md5, expected, chosen FROM prs WHERE prompt IS NOT NULL AND prompt <> ''), a AS (WITH traces AS (SELECT ord, chosen AS reasoning FROM c), {_FINAL} SELECT ord, answer FROM ext), g AS (SELECT prompt_md5, CASE WHEN {_HASH('prompt_md5')} % 3 <> 0 THEN first(expected ORDER BY ord) FILTER (nullif(expected, '') IS NOT NULL) END AS given, first(answer ORDER BY ord) FILTER (nullif(answer, '') IS NOT NULL) AS fallback FROM c JOIN a USING (ord) GROUP BY 1) SELECT *, coalesce(given, fallback) AS resolved FROM g",
    "reranked": f"WITH {_RANKED} SELECT mode, problem_id, ord, score FROM best",
    "rerank_modes": f"WITH {_RANKED} SELECT mode, count(*) AS problems, count(*) FILTER (is_correct) AS solved, round(count(*) FILTER (is_correct) / count(*), 9) AS accuracy FROM best GROUP BY 1",
    "early_stop": """WITH RECURSIVE h AS (SELECT user_id % 50 AS run, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS step, round(avg(value), 6) AS score FROM events GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM h),
        f AS (SELECT run, k, score, step, 0 AS since, CAST(NULL AS BIGINT) AS stopped FROM o WHERE k = 1 UNION ALL SELECT o.run, o.k, CASE WHEN o.score > f.score + 0.5 THEN o.score ELSE f.score END, CASE WHEN o.score > f.score + 0.5 THEN o.step ELSE f.step END, CASE WHEN o.score > f.score + 0.5 THEN 0 ELSE f.since + 1 END, CASE WHEN NOT o.score > f.score + 0.5 AND f.since + 1 >= 6 THEN o.step END FROM f JOIN o ON o.run = f.run AND o.k = f.k + 1 WHERE f.stopped IS NULL)
        SELECT run, score, step, since, stopped FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k DESC) AS z FROM f) WHERE z = 1""",
    "first_verified": f"WITH {TRACES}, i AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY ord) AS k FROM traces) SELECT problem_id, md5(arg_min(reasoning, k) FILTER (is_correct AND k <= 5)) AS solution_md5 FROM i GROUP BY 1",
    "rejected_choice": rf"WITH {TRACES}, g AS (SELECT id AS problem_id, TRY_CAST(list_last(regexp_extract_all(regexp_replace(coalesce(answer, ''), '[,$]', '', 'g'), '-?\d+\.?\d*')) AS DOUBLE) AS g FROM problems), t AS (SELECT ord, problem_id, reasoning, TRY_CAST(nullif(list_last(regexp_extract_all(reasoning, '####\s*(-?\d+\.?\d*)', 1)), '') AS DOUBLE) AS a FROM traces), w AS (SELECT problem_id, g, arg_min(reasoning, ord) FILTER (abs(a - g) > 0.01) AS r FROM g LEFT JOIN t USING (problem_id) GROUP BY 1, 2) SELECT problem_id, md5(coalesce(r, 'Step by step, the answer is ' || coalesce(CAST(CAST(trunc(g + 7) AS BIGINT) AS VARCHAR), '999') || '.')) AS rejected_md5, r IS NULL AS made FROM w",
    "acceptance_sampling": f"WITH l AS (SELECT l_orderkey, l_linenumber, {_HASH("l_orderkey || ':' || l_linenumber")} / 4294967296.0 < least(1.0::DOUBLE, (CAST(l_discount AS DOUBLE) + 0.03::DOUBLE) / (CAST(l_tax AS DOUBLE) + 0.05::DOUBLE)) AS ok FROM lineitem), s AS (SELECT *, min(l_linenumber) FILTER (NOT ok) OVER (PARTITION BY l_orderkey) AS stop FROM l) SELECT l_orderkey, count(*) AS drafted, CAST(count(*) FILTER (stop IS NULL OR l_linenumber < stop) AS INT) AS accepted, round(count(*) FILTER (stop IS NULL OR l_linenumber < stop) / count(*), 9) AS rate FROM s GROUP BY 1",
    "beam_search": _beam_sql(3, 2),
    "oracle_rerank": f"WITH {TRACES}, {_SCORED} SELECT problem_id, ord, round(score + CASE WHEN is_correct THEN 10.0 ELSE 0.0 END, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY round(score + CASE WHEN is_correct THEN 10.0 ELSE 0.0 END, 6) DESC, ord) AS rank FROM scored) WHERE rank = 1",
    "hash_split": f"SELECT DISTINCT provenance.pair_id AS pair_id, CASE WHEN {_HASH("provenance.pair_id || ':42'")} % 5 < 4 THEN 'train' ELSE 'eval' END AS part FROM dpo_pairs_v1 WHERE provenance.pair_id IS NOT NULL",
    "run_diff": f"WITH {_P}, r AS (SELECT date_trunc('day', made) AS day, backend, count(*) AS n, count(*) FILTER (ok) AS c FROM paths WHERE made IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, dense_rank() OVER (ORDER BY day DESC) AS k FROM r) SELECT a.backend, a.n AS current, b.n AS previous, a.n - b.n AS delta, a.c - b.c AS correct_delta FROM k a JOIN k b ON a.backend = b.backend AND a.k = 1 AND b.k = 2",
    "rejection_rounds": f"WITH {TRACES}, t AS (SELECT problem_id, ord, row_number() OVER (PARTITION BY problem_id ORDER BY ord) AS k FROM traces WHERE is_correct), d AS (SELECT problem_id, r, row_number() OVER (PARTITION BY problem_id ORDER BY r) AS k FROM (SELECT DISTINCT problem_id FROM t), range(3) x(r) WHERE {_HASH("problem_id || ':' || r")} % 3 = 0) SELECT CAST(r AS INT) AS round, problem_id, ord FROM d JOIN t USING (problem_id, k)",
    "problem_types": "SELECT source_dataset, CASE WHEN entry_point IS NOT NULL THEN 'code' ELSE 'math' END AS kind, count(*) AS n FROM problems GROUP BY 1, 2",
}
