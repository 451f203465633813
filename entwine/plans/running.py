"""Running totals in a total order, without a window over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entwine.plans.lineage import cut


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], hold: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """df with, for each name of `sums`, the total of its column over all rows before, in the order (which has to be total).

    Rows are range-partitioned and held, so that they keep their ranges; a range's own totals are a window inside it, and what
    lies before it is a sum over one row a range, the bound of the broadcast.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = hold(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.unboundedPreceding, -1
    zero = lambda c: F.coalesce(c, F.lit(0))
    of = held.groupBy("__range").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    of = of.select("__range", *[zero(F.sum(f"__{k}").over(Window.orderBy("__range").rowsBetween(*before))).alias(f"__{k}") for k in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(*before)
    out = held.withColumns({k: zero(F.sum(c).over(inside)) for k, c in sums.items()}).join(F.broadcast(of), "__range")
    return out.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__range", *[f"__{k}" for k in sums])
