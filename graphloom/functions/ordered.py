"""Numbers and running sums over a whole table in order, without one task that reads it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.checkpoints import cut


def numbered(df: DataFrame, order: list[Column | str], into: str = "pos", running: Column | None = None, so_far: str = "before") -> DataFrame:
    """`df` with the place of each row from 1 in an order, and what `running` adds up to before it.

    Rows are dealt by ranges of the order and written; only a count and a sum of each range meet in a task.
    """
    value = F.lit(0) if running is None else running
    rows = cut(df.withColumn("__value", value).orderBy(*order)).withColumn("__part", F.spark_partition_id())
    per = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.sum("__value").alias("__sum"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    per = per.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__over"))
    own = Window.partitionBy("__part").orderBy(*order)
    out = rows.join(F.broadcast(per), "__part").withColumn(into, (F.col("__ahead") + F.row_number().over(own)).cast("bigint"))
    if running is not None:
        out = out.withColumn(so_far, F.col("__over") + F.coalesce(F.sum("__value").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("__part", "__value", "__ahead", "__over")


def prefixes(path: Column) -> Column:
    """All folders that a path lies in, the top ones first."""
    parts = F.split(path, "/")
    return F.transform(F.slice(parts, 1, F.size(parts) - F.lit(1)), lambda d, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
