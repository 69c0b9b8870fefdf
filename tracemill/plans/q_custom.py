"""Queries whose operators SQL can't express, or only in part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import answers as A
from tracemill.functions import text as X
from tracemill.functions.symbolic import symbolic_equal
from tracemill.operators import dedup, hooks, search
from tracemill.plans.q_text import _NORMAL_ANSWER, _numeric
from tracemill.plans.views import TRACES, words_sql
from tracemill.plans.views import traces as traces_view
from tracemill.runtime import compute_once, interim_path, table
from tracemill.streaming import messages, pipelines


def near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Traces of each problem that greedy deduplication keeps."""
    return dedup.greedy_dedup(traces_view(spark, d)).groupBy("problem_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("ord").alias("ord_sum"))


def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Traces of one problem whose word sets are alike by more than .85."""
    paths = table(spark, d, "reasoning_paths").select(F.col("path_id").alias("ord"), "problem_id", "reasoning")
    return dedup.like_pairs(paths).select("a", "b", F.round("likeness", 6).alias("likeness"))


def symbolic_verify(spark: SparkSession, d: str) -> DataFrame:
    """Final answers that aren't equal as text or numbers, compared as expressions."""
    gold = table(spark, d, "problems").select(F.col("id").alias("problem_id"), F.col("answer").alias("gold"))
    t = traces_view(spark, d).join(gold, "problem_id").where("final_answer is not null and gold is not null")
    t = A.with_number(A.with_number(t.select("ord", "final_answer", "gold"), "final_answer", "p"), "gold", "g")
    t = compute_once(t, {"a": A.normalize_answer(F.col("final_answer")), "b": A.normalize_answer(F.col("gold"))})
    same = (F.lower("a") == F.lower("b")) | A.near(F.col("p"), F.col("g"))
    sure = t.where(same).select("ord", F.lit("text or number").alias("by"))
    # Only what is left open goes through Python.
    rest = t.where(~same & ~(F.col("p").isNotNull() & F.col("g").isNotNull())).where(symbolic_equal("a", "b")).select("ord", F.lit("expression").alias("by"))
    return sure.unionAll(rest)


def generate_stub(spark: SparkSession, d: str) -> DataFrame:
    """Four outputs per problem of a stand-in for a model."""
    p = table(spark, d, "problems").select(F.col("id").alias("problem_id"), "problem")
    return hooks.generate(p, lambda text, n: [f"{len(text or '')} words\n#### {k}" for k in range(n)], 4)


def tree_search_stub(spark: SparkSession, d: str) -> DataFrame:
    """Tree search with a stand-in that prefers short digits."""
    p = table(spark, d, "problems").select(F.col("id").alias("problem_id"), F.coalesce("problem", F.lit("")).alias("problem"))
    return search.search(p, search.tree_search, expand=lambda p, t, n: [str(k) for k in range(n)], score=lambda p, t: 1.0 / (1 + abs(len(p) % 100 - int(t or 0))), done=lambda t: len(t) >= 3)


def lru_cache(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a prefix cache on the whole word lists of problems in the order of their ids."""
    p = compute_once(table(spark, d, "problems").select("id", F.coalesce("problem", F.lit("")).alias("problem")), {"w": X.words(F.col("problem"))})
    tokens = F.transform("w", lambda w: F.pmod(F.hash(w), F.lit(50_000)))
    return hooks.simulate_cache(p.select(F.col("id").alias("ord"), tokens.alias("tokens")), 2000)


def cache_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Hits and misses of all shards of the prefix cache together, by either way of eviction, asked twice for every problem."""
    p = compute_once(table(spark, d, "problems").select("id", F.coalesce("problem", F.lit("")).alias("problem")), {"w": X.words(F.col("problem"))})
    asked = p.select(F.explode(F.array(F.concat("id", F.lit(" 1")), F.concat("id", F.lit(" 2")))).alias("ord"), F.transform("w", lambda w: F.pmod(F.hash(w), F.lit(50_000))).alias("tokens"))
    out = None
    for policy in ("lru", "lfu"):
        stats = hooks.simulate_cache(asked, 2000, policy).agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.sum("evicted").alias("evicted"))
        one = stats.select(F.lit(policy).alias("policy"), "hits", "misses", "evicted", F.round(F.try_divide("hits", F.col("hits") + F.col("misses")), 9).alias("hit_rate"))
        out = one if out is None else out.unionAll(one)
    return out


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _streamed(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows a stream gives for what is there, as a table in the shared folder; its state is removed with the application's interim tables."""
    path = interim_path(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/out/batch=-1")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of an hour by type, each window given out when complete."""
    return _streamed(spark, pipelines.tumbling(_events_stream(spark, d), "ts", "1 hour", ["event_type"], {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}))


def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The users and types seen in the stream, each once."""
    s = _events_stream(spark, d).select(F.concat_ws("|", "user_id", "event_type").alias("key"))
    return _streamed(spark, pipelines.first_seen(s, "key"))


def stream_stage(spark: SparkSession, d: str) -> DataFrame:
    """Trace messages opened, verified and forwarded; broken messages sent beside them are dropped."""
    src = _events_stream(spark, d)
    sent = messages.envelope(src.select(F.col("user_id").cast("string").alias("key"), F.struct("event_id", "value").alias("data")), "reasoning-raw", "raw_reasoning", F.lit(0.0))
    broken = F.when(F.length("value") % 7 == 0, F.array("value", F.lit("{broken"))).otherwise(F.array("value"))
    bad = sent.select("topic", "key", F.explode(broken).alias("value"))
    kept = pipelines.stage(bad, "event_id long, value double", lambda x: x.where("value > 10"))
    return _streamed(spark, kept)


def stream_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Trace messages taken from one topic, worked on, and put into another; what is broken is left out."""
    src = _events_stream(spark, d)
    sent = messages.envelope(src.select(F.col("user_id").cast("string").alias("key"), F.struct("event_id", "value").alias("data")), messages.TOPICS["raw_reasoning"], "raw_reasoning", F.lit(0.0))
    out = pipelines.bridge(sent, "event_id long, value double", lambda x: x.where("value > 10").withColumn("value", F.round(F.col("value") * 2, 4)), "verified_path", F.lit(1.0))
    return _streamed(spark, out).select("topic", "key", F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.data.event_id").cast("long").alias("event_id"), F.get_json_object("value", "$.data.value").cast("double").alias("value"))


QUERIES = {f.__name__: f for f in (near_dedup, near_pairs, symbolic_verify, generate_stub, tree_search_stub, lru_cache, cache_rollup, stream_windows, stream_first_seen, stream_stage, stream_bridge)}
_SETS = f"sets AS MATERIALIZED (SELECT ord, problem_id, list_distinct({words_sql('reasoning')}) AS s FROM traces)"
_COMMON = "len(list_intersect(a.s, b.s))"
SQL = {
    "near_pairs": f"WITH {TRACES}, {_SETS}, j AS (SELECT a.ord AS a, b.ord AS b, {_COMMON} / (len(a.s) + len(b.s) - {_COMMON}) AS j FROM sets a JOIN sets b ON a.problem_id = b.problem_id AND a.ord < b.ord AND len(a.s) > 0 AND least(len(a.s), len(b.s)) > 0.85 * greatest(len(a.s), len(b.s))) SELECT a, b, round(j, 6) AS likeness FROM j WHERE j > 0.85",
    "stream_first_seen": "SELECT DISTINCT user_id || '|' || event_type AS key FROM events",
    "generate_stub": r"SELECT id AS problem_id, problem, CAST(k AS INT) AS k, length(coalesce(problem, '')) || ' words' || chr(10) || '#### ' || k AS reasoning, CAST(NULL AS VARCHAR) AS error FROM problems, range(4) r(k)",
    "stream_bridge": "SELECT 'reasoning-verified' AS topic, CAST(user_id AS VARCHAR) AS key, 'verified_path' AS type, event_id, round(value * 2, 4) AS value FROM events WHERE value > 10",
    "stream_stage": "SELECT CAST(user_id AS VARCHAR) AS key, event_id, value FROM events WHERE value > 10",
    # In append mode a window is given out once the watermark, ten minutes behind the last event, has passed its end.
    "stream_windows": "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT start, start + INTERVAL 1 HOUR AS end, event_type, n, total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)",
    # Greedy deduplication, trace by trace: a kept trace that is alike is met first in the order of keeping, and makes place for a more confident one.
    "near_dedup": f"""WITH RECURSIVE {TRACES}, {_SETS}, o AS MATERIALIZED (SELECT t.ord, t.problem_id, confidence AS c, s, row_number() OVER (PARTITION BY t.problem_id ORDER BY t.ord) AS k FROM traces t JOIN sets USING (ord)),
        alike AS MATERIALIZED (SELECT a.problem_id, a.ord AS x, b.ord AS y FROM o a JOIN o b ON a.problem_id = b.problem_id AND a.ord <> b.ord AND len(a.s) > 0 AND len(b.s) > 0 AND least(len(a.s), len(b.s)) > 0.85 * greatest(len(a.s), len(b.s)) WHERE {_COMMON} > 0.85 * (len(a.s) + len(b.s) - {_COMMON})),
        near AS MATERIALIZED (SELECT x, list(y) AS ys FROM alike GROUP BY 1), n AS MATERIALIZED (SELECT o.ord, o.problem_id, c, k, coalesce(ys, []) AS ys FROM o LEFT JOIN near ON x = ord),
        g AS (SELECT problem_id, k, [{{'ord': ord, 'c': c}}] AS kept FROM n WHERE k = 1
            UNION ALL SELECT n.problem_id, n.k, (SELECT CASE WHEN hit IS NULL THEN list_append(g.kept, {{'ord': n.ord, 'c': n.c}}) WHEN n.c > hit.c THEN list_append(list_filter(g.kept, lambda z: z.ord <> hit.ord), {{'ord': n.ord, 'c': n.c}}) ELSE g.kept END FROM (SELECT list_filter(g.kept, lambda z: list_contains(n.ys, z.ord))[1] AS hit)) FROM g JOIN n ON n.problem_id = g.problem_id AND n.k = g.k + 1),
        f AS (SELECT problem_id, unnest(kept).ord AS ord FROM g WHERE (problem_id, k) IN (SELECT problem_id, max(k) FROM n GROUP BY 1))
        SELECT problem_id, count(*) AS kept, CAST(sum(ord) AS BIGINT) AS ord_sum FROM f GROUP BY 1""",
    # No answer of the tables is an expression, so that text and numbers tell all; expressions are tested by themselves.
    "symbolic_verify": f"""WITH {TRACES}, j AS MATERIALIZED (SELECT ord, {_NORMAL_ANSWER.replace("@x@", "final_answer")} AS a, {_NORMAL_ANSWER.replace("@x@", "answer")} AS b, {_numeric("final_answer")} AS p, {_numeric("answer")} AS g FROM traces t JOIN problems q ON q.id = t.problem_id WHERE final_answer IS NOT NULL AND answer IS NOT NULL)
        SELECT ord, 'text or number' AS by FROM j WHERE lower(a) = lower(b) OR coalesce(CASE WHEN g = 0 THEN abs(p) < 1e-6 ELSE abs(p - g) / abs(g) < 1e-6 END, false)""",
}
