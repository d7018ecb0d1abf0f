"""Running totals in one order over a whole table, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch


def running_total(rows: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add the sum of value over this row and all before it in a total order.

    Rows are cut into ranges of the order; each range is summed where it is and
    starts from the totals of the ranges before it, one row per range. The
    ranges are stored, as both steps must see the same ones.
    """
    part, amount, inner = "__range", "__amount", "__inner"
    ranged = rows.withColumn(amount, value).repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    inside = F.sum(amount).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    stored = Scratch(rows.sparkSession, "ordered").keep(ranged.withColumn(inner, inside), "ranges")
    sums = stored.groupBy(part).agg(F.sum(amount).alias("__sum"))
    before = sums.select(part, F.coalesce(F.sum("__sum").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = stored.join(F.broadcast(before), part)  # one row per range
    return out.withColumn(name, F.col("__before") + F.col(inner)).drop(part, amount, inner, "__before")
