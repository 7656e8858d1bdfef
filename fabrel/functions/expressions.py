"""The expression language of derived fields and rules, compiled to columns.

Expressions have the grammar of Python expressions, which Python's own `ast` reads: arithmetic, comparison, and / or /
not / in, calls and dotted paths. `if(c, a, b)`, `null`, `true` and `false` are allowed for.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ParseError

#: "Today" of years_since, unless another day is given.
TODAY = date(2025, 1, 15)


@dataclass(frozen=True)
class Value:
    """A column and what it holds: int, float, bool, str, date, datetime, list, null or any."""

    col: Column
    kind: str = "any"


#: Finds the value of a dotted path; aggregate(function, path) that of an aggregate over other rows.
Resolver = Callable[[tuple[str, ...]], Value]
Aggregator = Callable[[str, tuple[str, ...]], Value | None]


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    names = {T.BooleanType: "bool", T.StringType: "str", T.DateType: "date", T.TimestampNTZType: "datetime", T.TimestampType: "datetime", T.ArrayType: "list", T.NullType: "null"}
    return next((v for k, v in names.items() if isinstance(t, k)), "any")


def columns_of(schema: T.StructType) -> Resolver:
    """Paths of one name, from a DataFrame's schema."""

    def resolve(path: tuple[str, ...]) -> Value:
        if len(path) == 1 and path[0] in schema.names:
            return Value(F.col(f"`{path[0]}`"), kind_of(schema[path[0]].dataType))
        raise KeyError(".".join(path))

    return resolve


def two_places(x: Column) -> Column:
    """Two digits after the point, halves away from zero; a negative number keeps its sign where it rounds to zero."""
    near, sign = F.round(x * 100) / F.lit(100.0), x.cast("string").startswith("-")  # rounding makes -0.0 positive
    odd = F.when(F.isnan(near), "nan").when(near == float("inf"), "inf").when(near == float("-inf"), "-inf")
    return F.when(near.isNotNull(), F.coalesce(odd.when((near == 0) & sign, "-0.00"), F.format_string("%.2f", near)))


def display(v: Value) -> Column:
    """How a value prints: null as '', floats with two digits, lists in brackets."""
    if v.kind == "null":
        return F.lit("")
    if v.kind == "float":
        return F.coalesce(two_places(v.col.cast("double")), F.lit(""))
    if v.kind == "datetime":
        return F.coalesce(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    if v.kind == "list":
        return F.coalesce(F.concat(F.lit("["), F.array_join(v.col.cast("array<string>"), ", ", ""), F.lit("]")), F.lit(""))
    return F.coalesce(v.col.cast("string"), F.lit(""))


def truthy(v: Value) -> Column:
    """Null, 0 and '' are false, all else is true."""
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "bool":
        return F.coalesce(v.col, F.lit(False))
    if v.kind in ("int", "float"):
        return F.coalesce(v.col != 0, F.lit(False))
    if v.kind == "str":
        return F.coalesce(v.col != "", F.lit(False))
    return v.col.isNotNull()


def holds(v: Value) -> Column:
    """The test of `when`: neither null nor False; 0 and '' pass."""
    return F.coalesce(v.col, F.lit(False)) if v.kind == "bool" else v.col.isNotNull()


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def as_date(v: Value) -> Column:
    return v.col.cast("date") if v.kind in ("date", "datetime") else F.try_to_date(F.substring(v.col.cast("string"), 1, 10), "yyyy-MM-dd")


def years_since(day: Column, today: Column) -> Column:
    """Whole calendar years; 0 for days to come and for no date."""
    before = F.date_format(today, "MMdd") < F.date_format(day, "MMdd")
    return F.coalesce(F.greatest(F.year(today) - F.year(day) - before.cast("int"), F.lit(0)), F.lit(0)).cast("long")


def scaled_round(x: Column, digits: int) -> Column:
    """Halves away from zero, on x * 10**digits."""
    return F.round(x.cast("double") * F.lit(float(10**digits))) / F.lit(float(10**digits))


def _common(values: list[Value]) -> str:
    kinds = {v.kind for v in values if v.kind != "null"}
    return kinds.pop() if len(kinds) == 1 else "float" if kinds == {"int", "float"} else "any" if kinds else "null"


def _list_aggregate(name: str, v: Value) -> Value:
    """An aggregate of a list, or of a scalar as a list of one."""
    if v.kind != "list":
        if name == "count":
            return Value(F.lit(1).cast("long"), "int")
        return Value(F.lit(True), "bool") if name == "all_equal" else v
    add = F.aggregate(F.array_compact(v.col), F.lit(0.0), lambda a, x: a + x.cast("double"))
    n = F.size(F.array_compact(v.col))
    made = {
        "count": lambda: Value(F.size(v.col).cast("long"), "int"),
        "sum": lambda: Value(add, "float"),
        "avg": lambda: Value(F.when(n > 0, add / n).otherwise(F.lit(0.0)), "float"),
        "min": lambda: Value(F.array_min(v.col), "any"),
        "max": lambda: Value(F.array_max(v.col), "any"),
        "all_equal": lambda: Value(F.size(F.array_distinct(v.col)) <= 1, "bool"),
    }
    return made[name]()


#: Words of Python that are names here, unless they are operators of expressions.
_WORDS = "|".join(sorted(set(keyword.kwlist) - {"and", "or", "not", "in", "is", "None", "True", "False"}))
_NAMES = re.compile(rf"(\"[^\"]*\"|'[^']*')|\bif\s*\(|(?<=\.)(?:{'|'.join(keyword.kwlist)})\b|\b(?:{_WORDS})\b(?!\s*\()")
_MARK = "__name"


def parsed(text: str) -> ast.expr:
    """The syntax tree of an expression; Python's own words may name fields."""
    plain = _NAMES.sub(lambda m: m[0] if m[1] else "if_(" if m[0].endswith("(") else m[0] + _MARK, text.strip())
    try:
        return ast.parse(plain, mode="eval").body
    except SyntaxError as e:
        raise ParseError(f"not an expression: {text}") from e


class Compiler:
    """Turns expression text into a Value; `aggregate` finds aggregates over other rows, where there are any."""

    AGGREGATES = ("count", "sum", "avg", "min", "max", "all_equal")

    def __init__(self, resolve: Resolver, *, aggregate: Aggregator | None = None, today: date = TODAY) -> None:
        self.resolve, self.aggregate, self.today = resolve, aggregate, today

    def compile(self, text: str) -> Value:
        return self.value(parsed(text))

    def path(self, node: ast.expr) -> tuple[str, ...] | None:
        if isinstance(node, ast.Name):
            return (node.id.removesuffix(_MARK),)
        if isinstance(node, ast.Attribute) and (head := self.path(node.value)):
            return (*head, node.attr.removesuffix(_MARK))
        return None

    def value(self, node: ast.expr) -> Value:
        if isinstance(node, ast.Constant):
            kind = {bool: "bool", int: "int", float: "float", str: "str", type(None): "null"}.get(type(node.value))
            if kind is None:
                raise ParseError(f"not a literal: {node.value!r}")
            return Value(F.lit(node.value).cast("long") if kind == "int" else F.lit(node.value), kind)
        if (path := self.path(node)) is not None:
            words = {"null": Value(F.lit(None), "null"), "true": Value(F.lit(True), "bool"), "false": Value(F.lit(False), "bool")}
            return words[path[0]] if path[0] in words and len(path) == 1 else self.resolve(path)
        if isinstance(node, ast.List):
            items = [self.value(x) for x in node.elts]
            return Value(F.array(*[i.col for i in items]), "list")
        if isinstance(node, ast.UnaryOp):
            v = self.value(node.operand)
            return Value(~truthy(v), "bool") if isinstance(node.op, ast.Not) else Value(-v.col, v.kind)
        if isinstance(node, ast.BoolOp):
            tests = [truthy(self.value(x)) for x in node.values]
            out = tests[0]
            for t in tests[1:]:
                out = (out & t) if isinstance(node.op, ast.And) else (out | t)
            return Value(out, "bool")
        if isinstance(node, ast.BinOp):
            return self.arithmetic(type(node.op), self.value(node.left), self.value(node.right))
        if isinstance(node, ast.Compare):
            out, left = None, node.left
            for op, right in zip(node.ops, node.comparators, strict=True):
                one = self.comparison(op, left, right)
                out, left = one if out is None else out & one, right
            return Value(out, "bool")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            return self.call(node.func.id.rstrip("_"), node.args)
        raise ParseError(f"not supported: {ast.unparse(node)}")

    def arithmetic(self, op: type, a: Value, b: Value) -> Value:
        whole = a.kind == b.kind == "int"
        x, y = (v.col.cast("long") if whole else v.col.cast("double") for v in (a, b))
        kind = "int" if whole else "float"
        if op is ast.Div:
            return Value(F.when(y != 0, F.call_function("div", x, y)) if whole else F.try_divide(x, y), kind)
        made = {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Mod: lambda: F.try_mod(x, y)}
        if op not in made:
            raise ParseError(f"not an operator: {op.__name__}")
        return Value(made[op](), kind)

    def comparison(self, op: ast.cmpop, left: ast.expr, right: ast.expr) -> Column:
        """Equality counts nulls as equal; an order with null is false. A literal takes the type of what it meets."""
        a = self.value(left)
        if isinstance(op, (ast.In, ast.NotIn)):
            # Bare words in a list are enum values.
            items = [self.value(x) if not isinstance(x, ast.Name) or x.id in ("null", "true", "false") else Value(F.lit(x.id.removesuffix(_MARK)), "str") for x in getattr(right, "elts", [])]
            inside = F.lit(False)
            for i in items:
                inside = inside | a.col.eqNullSafe(i.col)
            return ~inside if isinstance(op, ast.NotIn) else inside
        b = self.value(right)
        if isinstance(op, ast.Eq):
            return a.col.eqNullSafe(b.col)
        if isinstance(op, ast.NotEq):
            return ~a.col.eqNullSafe(b.col)
        order = {ast.Lt: lambda: a.col < b.col, ast.LtE: lambda: a.col <= b.col, ast.Gt: lambda: a.col > b.col, ast.GtE: lambda: a.col >= b.col}
        return F.coalesce(order[type(op)](), F.lit(False))

    def call(self, name: str, args: list[ast.expr]) -> Value:
        if name in self.AGGREGATES and len(args) == 1:
            path = self.path(args[0])
            if self.aggregate and path and (found := self.aggregate(name, path)):
                return found
            return _list_aggregate(name, self.value(args[0]))
        v = [self.value(a) for a in args]
        text = lambda i: display(v[i]) if i < len(v) else F.lit("")
        if name == "concat":
            return Value(F.concat_ws("", *[display(x) for x in v]), "str")
        if name == "if":
            if len(v) < 3:
                raise ParseError("if needs a condition and two values")
            return Value(F.when(truthy(v[0]), v[1].col).otherwise(v[2].col), _common(v[1:3]))
        if name == "round":
            digits = ast.literal_eval(args[1]) if len(args) > 1 else 0
            return Value(scaled_round(v[0].col, digits), "float") if v[0].kind in ("int", "float") else v[0]
        if name == "years_since":
            return Value(years_since(as_date(v[0]), F.lit(self.today)), "int")
        if name == "days_between":
            return Value(F.coalesce(F.abs(F.datediff(as_date(v[1]), as_date(v[0]))), F.lit(0)).cast("long"), "int")
        if name in ("lower", "upper", "slug"):
            return Value({"lower": F.lower, "upper": F.upper, "slug": slug}[name](text(0)), "str")
        if name in ("starts_with", "ends_with"):
            return Value(F.startswith(text(0), text(1)) if name == "starts_with" else F.endswith(text(0), text(1)), "bool")
        raise ParseError(f"unknown function: {name}")


def with_expressions(df, made: dict[str, str], **how):
    """df with columns from expressions over its own columns; later ones may use earlier ones."""
    for name, text in made.items():
        df = df.withColumn(name, Compiler(columns_of(df.schema), **how).compile(text).col)
    return df


def default_chain(values: list[Value], when: Value | None, fallback: Value | None) -> Column:
    """The first that is not null, else the fallback; null where `when` does not hold."""
    found = F.coalesce(*[v.col for v in values], *([fallback.col] if fallback else []))
    return found if when is None else F.when(holds(when), found)


def compute(branches: list[tuple[Value | None, Value]]) -> Column:
    """The value of the first branch whose test holds; a test of None always does."""
    out = None
    for test, v in branches:
        condition = F.lit(True) if test is None else holds(test)
        out = F.when(condition, v.col) if out is None else out.when(condition, v.col)
    return F.lit(None) if out is None else out
