"""References: dereferencing by joins, integrity, bridges and child collections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.rng import Draw


def dereference(df: DataFrame, parent: DataFrame, ref: str, key: str, fields: Mapping[str, str]) -> DataFrame:
    """df with parent's fields ({column of parent: new name}) of the row whose key is df's ref; null where there is none.

    Spark broadcasts the parent if it knows it to be small enough.
    """
    side = parent.select(F.col(key).alias("__key"), *[F.col(c).alias(n) for c, n in fields.items()])
    return df.join(side, df[ref] == side["__key"], "left").drop("__key")


def last_row(df: DataFrame, column: str, order: str) -> DataFrame:
    """One row: the value of column in the row that is last by order."""
    return df.agg(F.max_by(column, order).alias(column))


def parent_index(d: Draw, parents: int) -> Column:
    """The row number of a parent, each as likely: a function of the child's row, so no join assigns it."""
    return d.h("ref") % F.lit(parents).cast("long")


def earlier_index(d: Draw) -> Column:
    """The number of an earlier row of the same table; null for the first."""
    return F.when(d.rid > 0, F.try_mod(d.h("ref"), d.rid))


def bridge(left: DataFrame, d: Draw, targets: int, low: int, high: int, *, key: str = "_rid") -> DataFrame:
    """(left, right): row numbers of a many-to-many link, low to high different ones for each row of left."""
    n = (d.h("n") % (high - low + 1) + low).cast("int")
    rows = left.select(F.col(key).alias("left"), F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))).alias("__i"))
    draw = Draw(d.seed, d.entity, d.field, F.col("left") * F.lit(high) + F.col("__i"))
    return rows.select("left", (draw.h("to") % F.lit(targets).cast("long")).alias("right")).dropDuplicates()


def with_keys(df: DataFrame, column: str, keys: DataFrame, *, branch: str | None = None) -> DataFrame:
    """df with keys (__at: row number, __key) in place of the row numbers in a column: plain ones, those in a list, or those of
    one branch of a polymorphic reference (a struct of type and id). A list is put together again from its own elements."""
    kind = df.schema[column].dataType
    if branch is not None:
        mine = F.col(f"{column}.type") == branch
        met = df.join(keys, F.when(mine, F.col(f"{column}.id").cast("long")) == F.col("__at"), "left")
        return met.withColumn(column, F.when(mine, F.col(column).withField("id", F.col("__key").cast(kind["id"].dataType))).otherwise(F.col(column))).drop("__at", "__key")
    if isinstance(kind, ArrayType):
        each = df.select("_rid", F.posexplode(column).alias("__place", "__of")).join(keys, F.col("__of") == F.col("__at"), "left")
        lists = each.groupBy(F.col("_rid").alias("__row")).agg(F.array_sort(F.collect_list(F.struct("__place", "__key"))).alias("__list"))
        empty = F.array().cast(f"array<{keys.schema['__key'].dataType.simpleString()}>")
        met = df.join(lists, F.col("_rid") == F.col("__row"), "left")
        return met.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce(F.transform("__list", lambda x: x["__key"]), empty))).drop("__row", "__list")
    return df.join(keys, F.col(column) == F.col("__at"), "left").withColumn(column, F.col("__key")).drop("__at", "__key")


def orphans(child: DataFrame, parent: DataFrame, ref: str, key: str) -> DataFrame:
    """The rows of child whose reference is set and meets no row of parent."""
    return child.where(F.col(ref).isNotNull()).join(parent.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def per_parent(parent: DataFrame, child: DataFrame, key: str, ref: str, made: Mapping[str, Column], empty: Mapping[str, Column] | None = None) -> DataFrame:
    """parent with aggregates over its rows of child; `empty` holds what stands for no rows."""
    sums = child.where(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("__ref")).agg(*[c.alias(n) for n, c in made.items()])
    out = parent.join(sums, parent[key] == sums["__ref"], "left").drop("__ref")
    return out.withColumns({n: F.coalesce(F.col(n), c) for n, c in (empty or {}).items()})


def hops(df: DataFrame, chain: Sequence[tuple[DataFrame, str, str, Mapping[str, str]]]) -> DataFrame:
    """Several dereferences in a row; each may start from a column that an earlier one brought."""
    for parent, ref, key, fields in chain:
        df = dereference(df, parent, ref, key, fields)
    return df
