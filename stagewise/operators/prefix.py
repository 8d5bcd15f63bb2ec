"""Running sums over a whole table in one order, without putting the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of the sums: that of its values over all rows up to this one in that order, itself included; nulls count as nothing.

    Rows are dealt out by ranges of the order and written, so that every use sees the same ranges. Each range is summed
    up, the sums of the ranges before are added (a row a range), and only rows of one range are sorted together.
    The order should be a total one: rows that are equal in it stand in any order, in one range.
    """
    named = df.select("*", *(F.coalesce(v, F.lit(0)).alias(f"{n}__value") for n, v in sums.items()))
    placed = stash(named.repartitionByRange(*order).withColumn("range__", F.spark_partition_id()), "ranges")
    by_range = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = placed.groupBy("range__").agg(*(F.sum(f"{n}__value").alias(f"{n}__total") for n in sums))
    before = totals.select("range__", *(F.coalesce(F.sum(f"{n}__total").over(by_range), F.lit(0)).alias(f"{n}__before") for n in sums))
    within = Window.partitionBy("range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(before), "range__")
    return out.select(*df.columns, *((F.col(f"{n}__before") + F.sum(f"{n}__value").over(within)).alias(n) for n in sums))
