"""How many solved problems stay solved under a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.runtime import compute_once, interim_table


def vote(verdict: Column) -> Column:
    """Strict majority of the verdicts that aren't null; ties are false, none gives null."""
    return F.when(F.count(verdict) == 0, None).otherwise(2 * F.count_if(verdict) > F.count(verdict))


def retention(outcomes: DataFrame) -> DataFrame:
    """Per change: applicability, accuracy before and after on the problems with both, and their ratio (0 without a base)."""
    both = F.col("applicable") & F.col("before").isNotNull() & F.col("after").isNotNull()
    stats = outcomes.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.count_if("applicable").alias("n_applicable"), F.count_if(both).alias("matched"), F.count_if(both & F.col("before")).alias("n_before"), F.count_if(both & F.col("after")).alias("n_after"))
    ratio = F.when(F.col("n_before") == 0, 0.0).otherwise(F.col("n_after") / F.col("n_before"))
    return stats.withColumns({"applicability": F.round(F.col("n_applicable") / F.col("n"), 9), "retention": F.round(ratio, 9)})


def geometric_mean(values: Column) -> Column:
    """0 if any value isn't positive, or there is none."""
    return F.coalesce(F.when(F.min(values) <= 0, 0.0).otherwise(F.exp(F.avg(F.ln(F.when(values > 0, values))))), F.lit(0.0))


#: Weights of a Poisson draw with mean 1 start at these values of a number from 0 to 1.
STARTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def uniform(key: Column, resample: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 out of the MD5 of key, resample and seed."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), resample.cast("string"), F.lit(str(seed)))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(4294967296.0)


def weight(u: Column) -> Column:
    """How often a key is in a resample: the Poisson draw of a uniform number."""
    w = F.lit(0)
    for k, start in enumerate(STARTS, 1):
        w = F.when(u >= start, k).otherwise(w)
    return w


def bootstrap_metric(rows: DataFrame, key: str, group: str, sums: dict[str, Column], metric: Column, resamples: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(group, value, low, high) of any metric of weighted sums, with a percentile interval.

    Rows with one key are drawn together, so that what belongs together stays
    so. Only the sums of each resample are shuffled. A resample whose metric is
    null is passed over; a group without any has null limits, and one row gives
    its own value for both. Rows with a null group or key are left out.
    """
    base = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("group"), F.col(key).alias("_key"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()))
    base = interim_table(base, "drawn")  # met twice, and what it comes from may be costly
    drawn = compute_once(base.repartition("group", "_key").withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))), {"_u": uniform(F.col("_key"), F.col("_b"), seed)}).withColumn("_w", weight(F.col("_u")))
    values = drawn.where("_w > 0").groupBy("group", "_b").agg(*(F.sum(F.col("_w") * F.col(n)).alias(n) for n in sums)).select("group", metric.alias("m")).where("m is not null")
    ordered = values.groupBy("group").agg(F.sort_array(F.collect_list("m")).alias("m")).withColumn("n", F.size("m"))
    alpha = (1 - level) / 2
    low, high = F.greatest(F.lit(0), F.floor(F.lit(alpha) * F.col("n"))), F.least(F.col("n") - 1, F.ceil(F.lit(1 - alpha) * F.col("n")) - 1)
    limits = ordered.select("group", F.get("m", low.cast("int")).alias("low"), F.get("m", high.cast("int")).alias("high"))
    whole = base.groupBy("group").agg(*(F.sum(n).alias(n) for n in sums)).select("group", metric.alias("value"))
    return whole.join(limits, "group", "left")


def kappa() -> Column:
    """Cohen's kappa of sums tp, fp, fn and tn; null without rows or where chance agrees always."""
    n = F.nullif(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.lit(0.0))
    po, a, b = (F.col("tp") + F.col("tn")) / n, (F.col("tp") + F.col("fn")) / n, (F.col("tp") + F.col("fp")) / n
    pe = a * b + (1 - a) * (1 - b)
    return F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe))
