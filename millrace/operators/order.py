"""Global row numbers without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """Adds ``name``: the place of each row in ``order``, counted from ``first``; make the order total.

    Rows are dealt by ranges of the order and settled; each range is numbered on its own, and
    starts at the sum of the counts of the ranges before it, one number per range.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))  # one row per range
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1 + F.col("__start") + first
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, place.cast("long")).drop("__range", "__start")
