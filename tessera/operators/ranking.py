"""Ranks and running sums over a whole table without a task that sees all of it: ranges, a sum per range, then a window inside each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import materialize


def sums_before(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """df and, as `name`, the sum of value over all rows that come earlier in the order (0 for the first).

    Spark cuts the table into ranges of the order from a sample and writes them; the sum of each range reaches the driver (a number for each
    partition) and is added to what a window finds inside the range. Rows that are equal in the order are in one range, in any order: make it unique.
    """
    spark = df.sparkSession
    ranged = materialize(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = {r["_range"]: r["s"] or 0 for r in ranged.groupBy("_range").agg(F.sum("_value").alias("s")).collect()}
    bases, base = [], 0
    for k in sorted(sums):
        bases.append((k, base))
        base += sums[k]
    starts = spark.createDataFrame(bases, "_range int, _base long")  # a row for each partition
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_base") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).cast("long"))
    return out.select(*df.columns, name)


def row_numbers(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df and, as `name`, each row's place in the order, from 1."""
    return sums_before(df, order, F.lit(1), name).withColumn(name, F.col(name) + 1)
