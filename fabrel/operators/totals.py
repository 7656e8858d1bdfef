"""Places and running sums in one order of all rows, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def in_ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """df as a written table in ranges of an order, each sorted; `__part` numbers the ranges, `__at` the rows within all."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return written(placed, "ranges").withColumn("__part", F.shiftright("__at", 33))


def running_sum(df: DataFrame, order: Sequence[Column | str], value: Column, name: str) -> tuple[DataFrame, int]:
    """df with `name`, the sum of value (whole numbers) over all rows before, and the sum over all rows. Ranges sum by
    themselves; a number for each range reaches the driver. Order must tell rows apart for equal results in reruns."""
    rows = in_ranges(df.withColumn("__value", F.coalesce(value.cast("long"), F.lit(0))), order)
    sums = sorted(map(tuple, rows.groupBy("__part").agg(F.sum("__value")).collect()))
    begins, total = [], 0
    for part, n in sums:
        begins.append((part, total))
        total += n
    begin = df.sparkSession.createDataFrame(begins, "__part long, __begin long")
    here = F.sum("__value").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("__here", F.coalesce(here, F.lit(0))).join(F.broadcast(begin), "__part")  # a row for each range
    return out.withColumn(name, F.col("__begin") + F.col("__here")).drop("__value", "__part", "__at", "__here", "__begin"), total


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """df with `name`, the place of a row from 0."""
    return running_sum(df, order, F.lit(1), name)[0]


def apportioned(rows: DataFrame, group: str, weight: Column, total: Column, name: str, *, key: str = "_rid") -> DataFrame:
    """rows with `name`, whole numbers that sum up to `total` in each group, in proportion to weight (whole, not negative).

    By largest remainders: each row gets the whole part of its share, and what is left goes by one to the rows with the largest
    remainders, the first by key among equals. Where all weights are 0 the shares are equal. Places of remainders are places
    in one order of all rows, so a group of any size is spread over tasks. total is the same for all rows of a group.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    made = rows.withColumns({"__w": F.coalesce(weight.cast("long"), F.lit(0)), "__t": total.cast("long")})
    sums = made.groupBy(F.col(group).alias("__group")).agg(F.sum("__w").alias("__all"), F.count("*").alias("__rows"))
    made = made.join(sums, F.col(group) == F.col("__group")).drop("__group")
    even = F.col("__all") == 0
    w, of = F.when(even, F.lit(1)).otherwise(F.col("__w")), F.when(even, F.col("__rows")).otherwise(F.col("__all"))
    made = made.withColumns({"__w": wide(w), "__all": wide(of)}).withColumn("__rest", F.pmod(wide(F.col("__t")) * F.col("__w"), F.col("__all")))
    made = made.withColumn("__share", ((wide(F.col("__t")) * F.col("__w") - F.col("__rest")) / F.col("__all")).cast("long"))
    ranked = numbered(made, [F.col(group), F.col("__rest").desc(), F.col(key)], "__rank")
    left = ranked.groupBy(F.col(group).alias("__group")).agg(F.min("__rank").alias("__first"), (F.first("__t") - F.sum("__share")).alias("__left"))
    out = ranked.join(left, F.col(group) == F.col("__group"))
    one = F.col("__rank") - F.col("__first") < F.col("__left")
    return out.withColumn(name, F.col("__share") + one.cast("long")).drop("__w", "__t", "__all", "__rows", "__rest", "__share", "__rank", "__group", "__first", "__left")
