"""Problem 5: a consensus verdict from judges that differ in skill, and in skill on either verdict."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.runtime import interim_table, table

#: Verdicts are given for items that so many judges voted on.
LEAST_JUDGES = 3
#: The model goes to the tasks whole; so many judges are its proven bound.
MOST_JUDGES = 1_000_000
ROUNDS, SETTLED = 60, 2e-3
#: Prior of a judge's ability (mean and precision) and of the logarithm of an item's ease (precision).
ABILITY, ABILITY_PRECISION, EASE_PRECISION = 1.0, 0.3, 8.0


@dataclass(frozen=True)
class Model:
    """Log-odds that each judge is right on an item of ordinary ease, for true REJECT (0) and ACCEPT (1); share of ACCEPT."""

    ability: np.ndarray
    share: float


def _right(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def expect(model: Model, judge: np.ndarray, vote: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of ACCEPT and ease of each of n items. judge, vote (1 is ACCEPT) and item are of one length."""
    ease = np.zeros(n)  # its logarithm
    skill = model.ability[judge]
    sign = np.where(vote[:, None] == np.array([0, 1]), 1.0, -1.0)
    for step in range(3):
        x = skill * np.exp(ease)[item][:, None]
        like = np.log(_right(sign * x))
        odds = np.log(model.share / (1 - model.share)) + np.bincount(item, like[:, 1] - like[:, 0], n)
        accept = _right(odds)
        if step == 2:
            break
        p = _right(x)
        q = np.stack([1 - accept, accept], 1)[item]
        grad = np.bincount(item, (q * ((sign > 0) - p) * x).sum(1), n) - EASE_PRECISION * ease
        curve = np.bincount(item, (q * p * (1 - p) * x * x).sum(1), n) + EASE_PRECISION
        ease = np.clip(ease + grad / curve, -2, 2)
    return accept, np.exp(ease)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Votes are numbers 2 * judge + verdict."""
    lists = batch.column(batch.schema.get_field_index("votes"))
    code = np.asarray(lists.flatten()).astype(np.int64)
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    return code >> 1, code & 1, np.repeat(np.arange(len(sizes)), sizes), len(sizes)


def usable_votes(verdicts: DataFrame) -> DataFrame:
    """(item, judge, vote): the latest usable vote of each judge on each item; vote 1 is ACCEPT, 0 is REJECT.

    Usable are verdicts whose letters spell accept or reject. Rows with a null
    item or judge, or a judge of blanks, say nothing. Of votes at one time the
    ACCEPT counts; a null time is the earliest.
    """
    letters = F.lower(F.regexp_replace("verdict", r"\P{L}", ""))
    judge = F.lower(F.trim("judge_id"))
    rows = verdicts.select(F.col("path_id").alias("item"), judge.alias("judge"), "judged_at", letters.alias("letters"))
    rows = rows.where("item is not null and judge != '' and letters in ('accept', 'reject')").withColumn("vote", (F.col("letters") == "accept").cast("int"))
    return rows.groupBy("item", "judge").agg(F.max(F.struct("judged_at", "vote")).alias("last")).select("item", "judge", F.col("last.vote").alias("vote"))


class Consensus:
    """Fits judges and items together by expectation-maximisation with gradient steps.

    Expectation runs in the tasks, on the votes of whole items; each returns the
    gradient and curvature of its judges, and the driver takes one damped step
    for all judges a round. Only sums per judge leave the tasks.
    """

    def __init__(self, votes: DataFrame) -> None:
        spark = votes.sparkSession
        votes = interim_table(votes, "votes")
        names = [r[0] for r in votes.select("judge").distinct().limit(MOST_JUDGES + 1).toLocalIterator()]
        if len(names) > MOST_JUDGES:
            raise ValueError(f"more than {MOST_JUDGES} judges")
        self.judges = sorted(names)
        numbers = spark.createDataFrame([(j, k) for k, j in enumerate(self.judges)], "judge string, number int")
        coded = votes.join(numbers, "judge").select("item", (F.col("number") * 2 + F.col("vote")).alias("code"))
        self.items = interim_table(coded.groupBy("item").agg(F.sort_array(F.collect_list("code")).alias("votes")), "items")
        self.model = Model(np.full((len(names), 2), ABILITY), 0.5)

    def fit(self) -> Consensus:
        n = len(self.judges)
        if not n:
            return self
        for _ in range(ROUNDS):
            model = self.model

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((n, 4))
                whole = np.zeros(2)
                for batch in batches:
                    judge, vote, item, count = _flat(batch)
                    if not count:
                        continue
                    accept, ease = expect(model, judge, vote, item, count)
                    whole += accept.sum(), count
                    for z, q in ((0, 1 - accept), (1, accept)):
                        e = ease[item]
                        p = _right(model.ability[judge, z] * e)
                        total[:, z] += np.bincount(judge, q[item] * ((vote == z) - p) * e, n)
                        total[:, 2 + z] += np.bincount(judge, q[item] * p * (1 - p) * e * e, n)
                met = np.flatnonzero(total.any(1))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), *(pa.array(np.append(total[met, k], whole[k] if k < 2 else 0.0)) for k in range(4))], ["j", "a", "b", "c", "d"])

            got = self.items.select("votes").mapInArrow(sums, "j long, a double, b double, c double, d double").groupBy("j").agg(*(F.sum(c).alias(c) for c in "abcd")).toPandas().set_index("j")
            whole = got.loc[-1]
            part = got.drop(index=-1).reindex(range(n), fill_value=0.0).to_numpy()
            grad = part[:, :2] - ABILITY_PRECISION * (model.ability - ABILITY)
            step = np.clip(grad / (part[:, 2:] + ABILITY_PRECISION), -1, 1)
            self.model = Model(np.clip(model.ability + step, -6, 6), float(np.clip(whole["a"] / max(whole["b"], 1), 0.01, 0.99)))
            if np.abs(step).max() < SETTLED:
                break
        return self

    def verdicts(self, least: int = LEAST_JUDGES) -> DataFrame:
        """(item, verdict, accept, ease, judges) of items with at least so many judges."""
        model = self.model

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                judge, vote, item, count = _flat(batch)
                accept, ease = expect(model, judge, vote, item, count) if count else (np.empty(0), np.empty(0))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(accept >= 0.5, "ACCEPT", "REJECT"), pa.string()), pa.array(accept), pa.array(ease), pa.array(np.bincount(item, minlength=count).astype(np.int32))], ["item", "verdict", "accept", "ease", "judges"])

        kind = self.items.schema["item"].dataType.simpleString()
        return self.items.where(F.size("votes") >= least).select("item", "votes").mapInArrow(label, f"item {kind}, verdict string, accept double, ease double, judges int")

    def reliability(self) -> DataFrame:
        """(judge, right_on_accept, right_on_reject): chance to be right on an item of ordinary ease."""
        right = _right(self.model.ability)
        rows = [(j, float(right[k, 1]), float(right[k, 0])) for k, j in enumerate(self.judges)]
        return self.items.sparkSession.createDataFrame(rows, "judge string, right_on_accept double, right_on_reject double")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = Consensus(usable_votes(table(spark, sf_dir, "judge_verdicts"))).fit()
    return fitted.verdicts().select(F.col("item").alias("path_id"), "verdict")


def stated_confidence(verdicts: DataFrame) -> DataFrame:
    """(judge, n_stated, stated): how sure a judge says to be, on average; confidences over 1 are out of 100, others that aren't within 0 to 1 say nothing."""
    c = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    rows = verdicts.select("path_id", F.lower(F.trim("judge_id")).alias("judge"), "judged_at", "verdict", c.alias("c")).where("judge != '' and c between 0 and 1").distinct()
    return rows.groupBy("judge").agg(F.count(F.lit(1)).alias("n_stated"), F.round(F.avg("c"), 9).alias("stated"))


def p5_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each judge's votes, estimated reliability on either verdict, and the confidence it states, against which the estimate can be held."""
    verdicts = table(spark, sf_dir, "judge_verdicts")
    votes = usable_votes(verdicts)
    fitted = Consensus(votes).fit()
    counts = votes.groupBy("judge").agg(F.count(F.lit(1)).alias("n_votes"), F.sum("vote").alias("n_accept"))
    joined = fitted.reliability().join(counts, "judge").join(stated_confidence(verdicts), "judge", "left")
    return joined.select(F.col("judge").alias("judge_id"), "n_votes", "n_accept", "right_on_accept", "right_on_reject", F.col("stated").alias("stated_confidence"))


def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per judge, how often and how high it states its confidence."""
    return stated_confidence(table(spark, sf_dir, "judge_verdicts"))


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha of the usable votes: agreement beyond chance; null without two votes on an item or with one verdict only."""
    votes = usable_votes(table(spark, sf_dir, "judge_verdicts"))
    items = votes.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("vote").alias("a")).where("n >= 2")
    total = items.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("votes"), F.sum("a").alias("a"), F.sum(2.0 * F.col("a") * (F.col("n") - F.col("a")) / (F.col("n") - 1)).alias("d"))
    chance = 2.0 * F.col("a") * (F.col("votes") - F.col("a")) / (F.col("votes") - 1)
    alpha = F.when(chance > 0, 1 - F.col("d") / chance)
    return total.select("items", "votes", F.round(F.col("a") / F.nullif(F.col("votes"), F.lit(0)), 9).alias("accept_share"), F.round(alpha, 9).alias("alpha"))


QUERIES = {"p5_found": p5_found, "p5_judges": p5_judges, "p5_confidence": p5_confidence, "p5_agreement": p5_agreement}
SQL = {
    "p5_confidence": """
        WITH r AS (SELECT DISTINCT path_id, lower(trim(judge_id)) AS judge, judged_at, verdict, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS c FROM judge_verdicts WHERE trim(judge_id) <> '')
        SELECT judge, count(*) AS n_stated, round(avg(c), 9) AS stated FROM r WHERE c BETWEEN 0 AND 1 GROUP BY 1
    """,
    "p5_agreement": """
        WITH v AS (SELECT path_id AS item, lower(trim(judge_id)) AS judge, judged_at, CASE WHEN lower(regexp_replace(verdict, '[^\\p{L}]', '', 'g')) = 'accept' THEN 1 ELSE 0 END AS vote
                   FROM judge_verdicts WHERE path_id IS NOT NULL AND trim(judge_id) <> '' AND lower(regexp_replace(verdict, '[^\\p{L}]', '', 'g')) IN ('accept', 'reject')),
        l AS (SELECT item, judge, vote FROM (SELECT *, row_number() OVER (PARTITION BY item, judge ORDER BY judged_at DESC NULLS LAST, vote DESC) AS k FROM v) WHERE k = 1),
        i AS (SELECT item, count(*) AS n, sum(vote) AS a FROM l GROUP BY item HAVING count(*) >= 2),
        t AS (SELECT count(*) AS items, CAST(sum(n) AS BIGINT) AS votes, CAST(sum(a) AS BIGINT) AS a, sum(2.0 * a * (n - a) / (n - 1)) AS d FROM i)
        SELECT items, votes, round(a / votes, 9) AS accept_share, round(1 - d / (2.0 * a * (votes - a) / (votes - 1)), 9) AS alpha FROM t
    """,
}
