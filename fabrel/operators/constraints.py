"""Value constraints: ranges, steps, lengths, allowed values, defaults, uniqueness."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParseError, UniquenessExhausted
from ..functions.rng import Draw
from ..model import Field
from ..storage import written
from .totals import numbered

UNIQUE_ATTEMPTS = 100
#: Attempts after which rows are dealt values, where the values that there are are known.
DRAWS = 12
#: Rounds whose values are put together into one table.
ROUNDS = 4


@dataclass(frozen=True)
class Bounds:
    low: float | str | None = None
    high: float | str | None = None
    open_low: bool = False
    open_high: bool = False
    step: float | None = None

    def closed(self, whole: bool) -> tuple[float | None, float | None]:
        """Closed bounds: an open one moves by 1 for whole numbers, else by a billionth of the span."""
        low, high = self.low, self.high
        if isinstance(low, str) or isinstance(high, str):
            return None, None
        span = abs(high - low) if low is not None and high is not None else max(abs(low or 0), abs(high or 0), 1)
        gap = 1 if whole else max(span * 1e-9, 1e-10)
        return (low + gap if self.open_low and low is not None else low), (high - gap if self.open_high and high is not None else high)


def _bound(text: str) -> float | str | None:
    text = text.strip()
    if not text:
        return None
    try:
        return float(text)
    except ValueError:
        return text


def bounds_of(f: Field) -> Bounds:
    """From @range(a..b), with `<` on an open side, @min, @max, @emin, @emax and @multiple_of."""
    low = high = step = None
    open_low = open_high = False
    for d in f.decorators:
        if d.name == "range":
            m = re.fullmatch(r"(.*?)(<?)\.\.(<?)(.*)", d.args[0])
            if not m:
                raise ParseError(f"not a range: {d.args[0]}")
            low, open_low, open_high, high = _bound(m[1]), bool(m[2]), bool(m[3]), _bound(m[4])
        elif d.name in ("min", "emin"):
            low, open_low = _bound(d.args[0]), d.name == "emin"
        elif d.name in ("max", "emax"):
            high, open_high = _bound(d.args[0]), d.name == "emax"
        elif d.name == "multiple_of":
            step = float(d.args[0])
    return Bounds(low, high, open_low, open_high, step)


def length_of(f: Field) -> tuple[int, int] | None:
    d = f.get("len") or f.get("count")
    if d is None:
        return None
    a, _, b = d.args[0].partition("..")
    return (int(a or 0), int(b or a)) if b or ".." not in d.args[0] else (int(a), int(a) + 10)


def within(x: Column, low: float | None, high: float | None, *, whole: bool = False) -> Column:
    cast = (lambda v: F.lit(int(v)).cast("long")) if whole else (lambda v: F.lit(float(v)))
    if low is not None:
        x = F.greatest(x, cast(low))
    return x if high is None else F.least(x, cast(high))


def snapped(x: Column, step: float, low: float | None, high: float | None, *, whole: bool = False) -> Column:
    """The nearest multiple of step, moved back into the bounds if it fell out of them."""
    s = F.lit(float(step))
    k = F.round(x.cast("double") / s)
    if low is not None:
        k = F.greatest(k, F.ceil(F.lit(float(low)) / s).cast("double"))
    if high is not None:
        k = F.least(k, F.floor(F.lit(float(high)) / s).cast("double"))
    return (k * s).cast("long") if whole else F.round(k * s, 10)


def fitted(text: Column, low: int, high: int) -> Column:
    """Padded with x or cut to a length in [low, high], in characters."""
    return F.substring(F.when(F.length(text) < low, F.rpad(text, low, "x")).otherwise(text), 1, high)


def letters(d: Draw, low: int = 3, high: int = 9) -> Column:
    """Some random lower-case letters."""
    text = F.concat(*[F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (d.h(f"ne{i}") % 26 + 1).cast("int"), F.lit(1)) for i in range(high)])
    return F.substring(text, F.lit(1), d.integer(low, high, "nelen").cast("int"))


def decorated(x: Column, f: Field, d: Draw, spark_type: str) -> Column:
    """The value constraints of a field, in order: allowed values, lengths, defaults, then bounds and steps."""
    if v := f.get("values"):
        x = d.pick(list(v.args), "values").cast(spark_type)
    if f.has("not_empty") and spark_type == "string":
        x = F.when(F.coalesce(x, F.lit("")) == "", letters(d)).otherwise(x)
    if (n := length_of(f)) and spark_type == "string":
        x = fitted(x, *n)
    if v := f.get("default"):
        x = F.coalesce(x, F.lit(v.args[0]).cast(spark_type))
    if spark_type in ("long", "int", "double") or spark_type.startswith("decimal"):
        whole = spark_type in ("long", "int")
        b = bounds_of(f)
        low, high = b.closed(whole)
        y = within(x if whole else x.cast("double"), low, high, whole=whole)
        if b.step:
            y = snapped(y, b.step, low, high, whole=whole)
        x = F.when(x.isNotNull(), y.cast(spark_type))  # bounds leave null alone
    return x


def unique_values(rows: DataFrame, make: Callable[[Column], Column], name: str, *, key: str = "_rid", attempts: int = UNIQUE_ATTEMPTS, taken: DataFrame | None = None, space: DataFrame | None = None, turn: int = 0) -> DataFrame:
    """(key, name): make(attempt) for each row, with the attempt raised until no two rows share a value; none has a value
    that `taken` (key, name) has.

    Of rows with the same value the first by key keeps it; nulls may repeat. Firsts are found by a minimum, which is
    taken before the shuffle, so neither nulls nor a common value gather in one task. Rounds join only what is
    still open, and each is a written table. Draws hardly find the last free values of a small space: rows that DRAWS attempts
    do not settle are dealt those of `space` (name, no value twice) that are free, in an order that depends on the turn.
    """
    found, left = None, rows.select(key)

    def free(values: DataFrame) -> DataFrame:
        for used in (u for u in (taken, found) if u is not None):
            values = values.join(used.select(name), name, "left_anti")
        return values

    for attempt in range(attempts):
        if attempt == DRAWS and space is not None:
            mixed = numbered(free(space), [F.xxhash64(F.lit(turn), name), name], "__n")
            marked = numbered(left, [key], "__n").join(mixed, "__n", "left").select(key, name, F.col(name).isNotNull().alias("__ok"))
        else:
            tried = left.withColumn(name, make(F.lit(attempt)))
            firsts = free(tried.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias("__first")))
            marked = tried.join(firsts.select(F.col("__first"), F.lit(True).alias("__won")), F.col(key) == F.col("__first"), "left")
            marked = marked.select(key, name, (F.col(name).isNull() | F.coalesce("__won", F.lit(False))).alias("__ok"))
        tried = written(marked, f"unique-{name}")
        good = tried.where("__ok").select(key, name)
        found = good if found is None else found.unionByName(good)
        if attempt % ROUNDS == ROUNDS - 1:  # so that later rounds read one table of what is taken
            found = written(found, f"unique-{name}")
        left = tried.where("NOT __ok").select(key)
        if left.isEmpty():
            return found
    raise UniquenessExhausted(f"{name}: no unique values after {attempts} attempts")
