"""Running sums over a whole table's order, without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels of ranges over ranges; the topmost has a row for each width ** LEVELS values.
LEVELS = 3


def running_sum(df: DataFrame, order: str, amount: str, out: str, width: int = 1 << 12, levels: int = LEVELS) -> DataFrame:
    """df with the sum of `amount` up to and with each row by a whole-number column of distinct values.

    Rows fall into ranges of `width` values, ranges into ranges of ranges. Windows run within a range;
    what came before a range is the running sum of the ranges' sums, one level up. Only the topmost
    level, of 2^36 values a row, is one task's.
    """
    if not levels:
        everything = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(amount).over(everything).cast("bigint"))
    at = f"__bin{levels}"
    binned = df.withColumn(at, F.floor(F.col(order) / width))
    sums = running_sum(binned.groupBy(at).agg(F.sum(amount).alias("__sum")), at, "__sum", "__upto", width, levels - 1)
    offsets = sums.select(at, (F.col("__upto") - F.col("__sum")).alias("__before"))
    within = Window.partitionBy(at).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = binned.withColumn("__local", F.sum(amount).over(within))
    return local.join(offsets, at).withColumn(out, (F.col("__local") + F.col("__before")).cast("bigint")).select(*df.columns, out)
