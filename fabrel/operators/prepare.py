"""Preparation of source tables: top-k, first-wins, lookups with defaults, roll-ups, frequencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import Draw
from ..storage import written


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows by order; Spark keeps k rows a task."""
    return df.orderBy(*order).limit(k)


def first_wins(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """For each key the row that comes first: the least of the order, by an aggregate that sums up before it shuffles."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("__first")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def lookup(df: DataFrame, other: DataFrame, on: Mapping[str, str], take: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """df with columns of other ({new name: (column, default)}) where the keys ({df's: other's}) meet."""
    side = other.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(on.values())], *[F.col(c).alias(f"__{n}") for n, (c, _) in take.items()])
    tests = [df[a] == side[f"__k{i}"] for i, a in enumerate(on)]
    out = df.join(side, tests, "left")
    return out.select(*[df[c] for c in df.columns], *[F.coalesce(F.col(f"__{n}"), d).alias(n) for n, (_, d) in take.items()])


def prefix_rollup(df: DataFrame, code: str, name: str, order: str, lengths: Sequence[int] = (1, 2)) -> DataFrame:
    """(prefix, name): the prefixes of codes, each with the name that comes first by order."""
    rows = df.select(F.explode(F.array(*[F.substring(code, 1, n) for n in lengths])).alias("prefix"), name, order)
    return rows.groupBy("prefix").agg(F.min_by(name, F.struct(order, name)).alias("name"))


def every(df: DataFrame, number: str, n: int) -> DataFrame:
    """Rows whose number is divisible by n."""
    return df.where(F.col(number) % n == 0)


def last_segment(path: Column, sep: str = "/") -> Column:
    return F.element_at(F.split(path, f"\\Q{sep}\\E"), -1)


def label_of(code: Column, labels: Mapping[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in labels.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column."""
    total = df.agg(F.count("*").alias("total"))
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def moments(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Count, mean, standard deviation, least and largest of a column, of each group or of all rows."""
    c = F.col(column).cast("double")
    made = [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("least"), F.max(c).alias("largest")]
    return df.groupBy(by).agg(*made) if by else df.agg(*made)


def weighted_pick(rows: DataFrame, weights: DataFrame, value: str, weight: str, d: Draw, name: str) -> DataFrame:
    """rows with a value drawn by weight: the one in whose interval of the cumulated weights the roll falls.

    The running sum is over the list of values, which has one row each. Intervals are listed under the cells of an even grid
    that they touch, so the join is on a cell, and Spark broadcasts the list if its size allows it.
    """
    run = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    listed = written(weights.where(F.col(weight) > 0).select(F.col(value).alias("__v"), F.sum(weight).over(run).cast("double").alias("__hi"), F.col(weight).cast("double").alias("__w")), "weights")
    n, total = listed.agg(F.count("*"), F.max("__hi")).first()
    if not n:
        return rows.withColumn(name, F.lit(None).cast(weights.schema[value].dataType))
    cells = 4 * n
    cell = lambda x: F.least(F.floor(x * F.lit(cells / total)), F.lit(cells - 1)).cast("long")
    lo = F.col("__hi") - F.col("__w")
    grid = listed.select("__v", "__hi", lo.alias("__lo"), F.explode(F.sequence(F.greatest(cell(lo) - 1, F.lit(0)), F.least(cell(F.col("__hi")) + 1, F.lit(cells - 1)))).alias("__cell"))
    rolled = rows.withColumn("__roll", d.u("pick") * F.lit(float(total)))
    rolled = rolled.withColumn("__at", cell(F.col("__roll")))
    inside = (F.col("__at") == F.col("__cell")) & (F.col("__roll") >= F.col("__lo")) & (F.col("__roll") < F.col("__hi"))
    return rolled.join(grid, inside).withColumn(name, F.col("__v")).drop("__roll", "__at", "__cell", "__lo", "__hi", "__v")
