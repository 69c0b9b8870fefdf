"""Problem 6: at most so many records per contributor, the best by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.runtime import cut_lineage, interim_table, table

CAP = 8
#: Midpoints of a round per contributor, plus one.
FAN = 64
#: Rows of one contributor that go to one part; a larger contributor is dealt into as many parts as it takes.
PART = 500_000
HUGE = 1.7976931348623157e308


def _salts() -> Column:
    """One row for each part of a contributor."""
    return F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")


def _cutoffs(scored: DataFrame, cap: int) -> DataFrame:
    """(who, cut, quota): the records above cut are kept, and of those at cut the first quota.

    All contributors narrow their bounds together: a round counts the records of
    every part between the bounds, and goes on in the part that holds the cap-th
    record. A contributor is done when its bounds meet or its part is kept whole.
    """
    active = cut_lineage(scored.groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.max("parts").alias("parts")).where(f"n >= {cap}").select("who", F.lit(cap).cast("long").alias("need"), "n", "lo", "hi", "parts"))
    done = None
    while True:
        ended = active.where("lo = hi or need = n").select("who", F.col("lo").alias("cut"), F.when(F.col("need") == F.col("n"), F.col("n")).otherwise(F.col("need")).alias("quota"), "parts")
        done = ended if done is None else done.unionAll(ended)
        active = active.where("lo < hi and need < n")
        if active.isEmpty():
            return cut_lineage(done)
        bounds = active.select("who", "need", "lo", "hi", "parts", _salts())
        inside = scored.drop("parts").join(bounds, ["who", "salt"]).where("score >= lo and score <= hi")
        part = F.least(F.lit(FAN - 1), F.floor((F.col("score") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * FAN).cast("int"))
        counts = inside.groupBy("who", "need", "parts", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
        above = F.sum("n").over(Window.partitionBy("who").orderBy(F.col("part").desc())) - F.col("n")
        active = cut_lineage(counts.withColumn("above", above).where("above < need and need <= above + n").select("who", (F.col("need") - F.col("above")).alias("need"), "n", "lo", "hi", "parts"))


def over_cap(records: DataFrame, cap: int = CAP) -> DataFrame:
    """The ids that a cap per contributor leaves out, of records with id, who and score.

    Kept are the first cap by score from high to low, then id from small to
    large; null and NaN scores come after every number. Rows with one id count
    once, with their least who and greatest score. A null id is left out of all
    counts, and records of a null contributor are never cut, as nobody is known
    to dominate by them. Infinite scores count as the largest finite ones. Extra
    columns are ignored.
    """
    score = F.when(F.isnan("score") | F.col("score").isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(-HUGE), F.least(F.lit(HUGE), F.col("score"))) + F.lit(0.0))
    one = records.where("id is not null").select("id", "who", score.alias("score")).groupBy("id").agg(F.min("who").alias("who"), F.max("score").alias("score")).where("who is not null")
    parts = F.ceil(F.col("n") / PART).cast("int")
    crowded = cut_lineage(one.groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored")).where(f"n > {cap}").withColumn("parts", parts))
    # Contributors of several parts are one for every PART rows of the table at most, so that they may go to all tasks.
    large = F.broadcast(crowded.where("parts > 1").select("who", F.col("parts").alias("dealt")))
    salted = one.join(large, "who", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("dealt", F.lit(1))).cast("int")).drop("dealt")
    rows = interim_table(salted.join(crowded.select("who", "n_scored", "parts", _salts()), ["who", "salt"]), "capped")
    scored = rows.where("score is not null").select("who", "salt", "score", "parts")
    cuts = _cutoffs(scored, cap)
    judged = rows.drop("parts").join(cuts.select("*", _salts()).drop("parts"), ["who", "salt"], "left")
    fate = (
        F.when(F.col("cut").isNull(), F.when(F.col("score").isNull(), "tie").otherwise("keep"))
        .when(F.col("score").isNull() | (F.col("score") < F.col("cut")), "drop")
        .when((F.col("score") > F.col("cut")), "keep")
        .otherwise("tie")
    )
    judged = judged.select("id", "who", fate.alias("fate"), F.coalesce("quota", F.lit(cap) - F.col("n_scored")).alias("quota"))
    # A part kept whole has its least score as cut and its size as quota, so all above are kept and the ties at the cut fit.
    ties = judged.where("fate = 'tie'")
    place = F.row_number().over(Window.partitionBy("who").orderBy("id"))
    first = ties.withColumn("place", place).where(f"place <= {cap}").where("place <= quota").select("id")
    return judged.where("fate != 'keep'").join(first, "id", "left_anti").select("id")


def contributor(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def latest_scores(scores: DataFrame) -> DataFrame:
    """(id, score) of the row with the latest scored_at; of rows at one time the greatest score; a null time is the earliest."""
    last = F.max(F.struct("scored_at", F.col("diversity_score").alias("score")))
    return scores.where("pair_id is not null").groupBy(F.col("pair_id").alias("id")).agg(last.alias("last")).select("id", F.col("last.score").alias("score"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "dpo_pairs_v1").select(F.col("provenance.pair_id").alias("id"), contributor("pair.problem_id").alias("who"))
    records = pairs.join(latest_scores(table(spark, sf_dir, "sample_pairs")), "id", "left")
    return over_cap(records).select(F.col("id").alias("pair_id"))


SQL = {
    "p6_found": """
        WITH s AS (SELECT pair_id, diversity_score AS v, row_number() OVER (PARTITION BY pair_id ORDER BY scored_at DESC NULLS LAST, CASE WHEN isnan(diversity_score) THEN NULL ELSE diversity_score END DESC NULLS LAST) AS k FROM sample_pairs),
        p AS (SELECT provenance.pair_id AS pair_id, min(lower(trim(pair.problem_id))) AS who FROM dpo_pairs_v1 GROUP BY 1),
        r AS (SELECT p.pair_id, row_number() OVER (PARTITION BY who ORDER BY CASE WHEN isnan(v) THEN NULL ELSE v END DESC NULLS LAST, p.pair_id) AS n FROM p LEFT JOIN s ON s.pair_id = p.pair_id AND s.k = 1 WHERE who IS NOT NULL)
        SELECT pair_id FROM r WHERE n > 8 AND pair_id IS NOT NULL
    """,
}
QUERIES = {"p6_found": p6_found}
