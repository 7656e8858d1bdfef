"""Rules over tables: violations, counts, composite uniqueness, cardinality and checks across rows."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParseError
from ..functions.expressions import Compiler, Value, display
from ..functions.rng import Draw
from ..model import Rule


def verdict(rule: Rule, compiler: Compiler) -> Column:
    """Whether a row keeps the rule; true where its `when` does not hold."""
    check = F.coalesce(compiler.compile(rule.check).col.cast("boolean"), F.lit(False))
    if rule.when is None:
        return check
    when = F.coalesce(compiler.compile(rule.when).col.cast("boolean"), F.lit(False))
    return F.when(when, check).otherwise(F.lit(True))


def enforced(rule: Rule, d: Draw) -> Column:
    """Whether a probabilistic rule binds a row."""
    return d.chance(rule.probability, "rule") if rule.mode == "probability" else F.lit(rule.mode == "strict")


def violations(df: DataFrame, rule: Rule, compiler: Compiler) -> DataFrame:
    """The rows that break the rule."""
    return df.where(~verdict(rule, compiler))


def count_violations(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row with the number of rows that break each of the named rules."""
    return df.agg(*[F.sum(F.when(~F.coalesce(ok, F.lit(False)), 1).otherwise(0)).cast("long").alias(name) for name, ok in rules])


def duplicates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Groups of rows that agree on all fields (nulls agree): fields and n."""
    return df.groupBy(*fields).agg(F.count("*").alias("n")).where("n > 1")


def cardinality(parent: DataFrame, child: DataFrame, key: str, ref: str, low: int | None, high: int | None) -> DataFrame:
    """Parents whose number of children is out of [low, high]: key and n, with 0 for parents without any."""
    n = child.groupBy(F.col(ref).alias("__ref")).agg(F.count("*").alias("n"))
    out = parent.select(key).join(n, F.col(key) == F.col("__ref"), "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col("n") < low)
    if high is not None:
        bad = bad | (F.col("n") > high)
    return out.where(bad)


def cross_row(df: DataFrame, group_by: Value, check: str, columns: dict[str, Value]) -> DataFrame:
    """(group, n, ok): groups of two rows or more and whether they agree: check is `all_equal(field)`.

    The key is the printed value, so null is ''. Minimum and maximum are summed before the shuffle.
    """
    m = re.fullmatch(r"\s*all_equal\((\w+)\)\s*", check)
    if not m:
        raise ValueError(f"not a check across rows: {check}")
    value = columns[m[1]].col
    rows = df.select(display(group_by).alias("group"), value.alias("__v"))
    agree = F.min("__v").eqNullSafe(F.max("__v")) & ((F.count("__v") == 0) | (F.count("__v") == F.count("*")))
    return rows.groupBy("group").agg(F.count("*").alias("n"), agree.alias("ok")).where("n >= 2")


def first_of_each(df: DataFrame, fields: Sequence[str], taken: DataFrame | None, free: Column, *, key: str = "_rid") -> DataFrame:
    """The rows of df that are the first by key of those that agree on fields (nulls agree), where taken has none of them; and
    the free ones. Firsts are found by a minimum, which is taken before the shuffle, so a common value is no large group."""
    bound = df.where(~free)
    firsts = bound.groupBy(*fields).agg(F.min(key).alias("__first"))
    if taken is not None:
        used = taken.select(*[F.col(f).alias(f"__{f}") for f in fields]).distinct()
        same = [F.col(f).eqNullSafe(F.col(f"__{f}")) for f in fields]
        firsts = firsts.join(used, same, "left_anti")
    return bound.join(firsts.select(F.col("__first").alias(key)), key, "left_semi").unionByName(df.where(free))


def count_bounds(text: str) -> tuple[tuple[str, ...], int | None, int | None]:
    """(path, least, most) of `count(E.x) op n` or `count(E.x) in a..b`."""
    m = re.fullmatch(r"\s*count\(\s*([\w.]+)\s*\)\s*(?:(==|>=|<=|>|<)\s*(\d+)|in\s+(\d+)\s*\.\.\s*(\d+))\s*", text)
    if not m:
        raise ParseError(f"not a rule on a count: {text}")
    path = tuple(m[1].split("."))
    if m[4]:
        return path, int(m[4]), int(m[5])
    n = int(m[3])
    return path, *{"==": (n, n), ">=": (n, None), ">": (n + 1, None), "<=": (None, n), "<": (None, n - 1)}[m[2]]


def fields_of(text: str) -> list[tuple[str, ...]]:
    """The dotted paths of `unique(E.a, E.b)` or `count(E.x) op n`."""
    tree = ast.parse(re.sub(r"\s+in\s+(\S+)\.\.(\S+)", r" in [\1, \2]", text), mode="eval")
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Attribute):
            path, at = [node.attr], node.value
            while isinstance(at, ast.Attribute):
                path.append(at.attr)
                at = at.value
            if isinstance(at, ast.Name):
                out.append((at.id, *reversed(path)))
    return out
