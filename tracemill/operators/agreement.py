"""Agreement of two raters, and shortcuts that only one of them sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(a: str = "a", b: str = "b") -> list[Column]:
    """Aggregates of two verdict columns: counts of each combination, and of rows without one of both."""
    x, y = F.col(a), F.col(b)
    return [
        F.count_if(x & y).alias("tp"), F.count_if(~x & y).alias("fp"), F.count_if(x & ~y).alias("fn"), F.count_if(~x & ~y).alias("tn"), F.count_if(x.isNull() | y.isNull()).alias("dropped"),
    ]


def with_kappa(counts: DataFrame) -> DataFrame:
    """n, agreement and Cohen's kappa of counts by rates(); without rows 0, and where chance agrees always 1 for full agreement and else 0."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    po = (F.col("tp") + F.col("tn")) / F.col("n")
    a, b = (F.col("tp") + F.col("fn")) / F.col("n"), (F.col("tp") + F.col("fp")) / F.col("n")
    pe = a * b + (1 - a) * (1 - b)
    kappa = F.when(F.col("n") == 0, 0.0).when(F.abs(1 - pe) < 1e-12, F.when(F.abs(1 - po) < 1e-12, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return counts.withColumn("n", n).withColumns({"agreement": F.round(F.when(F.col("n") == 0, 0.0).otherwise(po), 9), "kappa": F.round(kappa, 9)})


def pair_report(rows: DataFrame) -> DataFrame:
    """Agreement of each pair of raters (pair, a, b, bin), overall and by bin; per bin, n_rows counts rows without a verdict too."""
    sets = rows.groupingSets([["pair"], ["pair", "bin"]], "pair", "bin").agg(*rates(), F.count(F.lit(1)).alias("n_rows"), F.grouping("bin").cast("int").alias("overall"))
    return with_kappa(sets)


def verdict_of(text: Column) -> Column:
    """true for accept, false for reject, null for anything else."""
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
    return F.when(letters == "ACCEPT", True).when(letters == "REJECT", False)
