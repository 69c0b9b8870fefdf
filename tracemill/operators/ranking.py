"""Places within groups that may each hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.runtime import interim_table


def place_in_group(df: DataFrame, group: str, *order: str, place: str = "place", size: str = "size") -> DataFrame:
    """df with the place from 1 of each row in its group, and the group's size. The order must be total.

    Rows are range-partitioned by group and order, numbered within their part,
    and moved on by the sizes of the parts before; so a crowded group is spread
    over many tasks, where a plain window would sort it in one. The parts are
    written once, since their bounds are drawn from a sample.
    """
    parted = df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    parted = interim_table(parted, "parted")
    counts = parted.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    counts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias(size))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    joined = parted.withColumn("_k", within).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(place, F.col("_k") + F.col("_before")).drop("_part", "_k", "_g", "_p", "_before")
