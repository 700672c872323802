"""Global ranks without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


def global_rank(df: DataFrame, by: list[str], to: str = "rank") -> DataFrame:
    """df with a long from 1 on, in the order of ``by`` (which should tell rows apart).

    Rows are dealt into sorted ranges; each range is ranked alone, and starts where the ranges before it end. The ranges are cut by a
    table, since their bounds come from a sample; only one row a range goes through a single task."""
    dealt = materialise(df.repartitionByRange(*by).withColumn("_slice", F.spark_partition_id()), "ranges")
    size = dealt.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = size.select(F.col("_slice").alias("_at"), (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_slice")) - F.col("_n")).alias("_before"))
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_slice").orderBy(*by)))
    return local.join(F.broadcast(before), F.col("_slice") == F.col("_at")).withColumn(to, (F.col("_local") + F.col("_before")).cast("long")).drop("_slice", "_at", "_before", "_local")
