"""Distributions in closed form from uniform draws."""

from __future__ import annotations

from itertools import accumulate
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Decorator
from .rng import Draw

ZIPF_RANKS = 1000


def normal(d: Draw, mean: float, sd: float, salt: str = "n") -> Column:
    """Box-Muller."""
    r = F.sqrt(F.lit(-2.0) * F.log(d.u_open(salt + "1")))
    return F.lit(float(mean)) + F.lit(float(sd)) * r * F.cos(F.lit(2 * pi) * d.u(salt + "2"))


def shares_passed(shares: list[float], x: Column) -> Column:
    """How many of the rising shares x has reached, by bisection; x is evaluated once."""
    table, n = F.array(*[F.lit(c) for c in shares]), len(shares)
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"), x.alias("x"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["lo"] + at["hi"], 1)
        passed = F.get(table, middle) <= at["x"]
        lo, hi = F.when(passed, middle + 1).otherwise(at["lo"]), F.when(passed, at["hi"]).otherwise(middle)
        return F.when(at["lo"] < at["hi"], F.struct(lo.alias("lo"), hi.alias("hi"), at["x"].alias("x"))).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(n.bit_length(), 1))), start, halve, lambda at: at["lo"])


def zipf(d: Draw, s: float, n: int = ZIPF_RANKS) -> Column:
    """Rank by the cumulated shares of 1 / k**s: the number of shares that u passes, plus one."""
    mass = [1 / k**s for k in range(1, n + 1)]
    total = sum(mass)
    return shares_passed([x / total for x in accumulate(mass[:-1])], d.u("z")) + 1 if n > 1 else F.lit(1)


def sample(spec: Decorator, d: Draw, low: float | None, high: float | None) -> Column:
    """A draw from `@dist(name, ...)`, clamped to the range where it is continuous or counts."""
    name = spec.args[0] if spec.args else "uniform"
    number = lambda *names, default: float(spec.option(*names, default=str(default)))
    mean, sd = number("μ", "mu", "mean", default=0), number("σ", "sigma", "sd", "std", default=1)
    if name == "uniform":
        lo, hi = 0.0 if low is None else low, 1000.0 if high is None else high
        return F.lit(float(lo)) + d.u("d") * F.lit(float(hi) - float(lo))
    if name == "normal":
        x = normal(d, mean, sd)
    elif name == "lognormal":
        x = F.exp(normal(d, mean, sd))
    elif name == "exponential":
        x = -F.log(d.u_open("d")) / F.lit(number("λ", "lambda", default=1))
    elif name == "geometric":
        x = F.floor(F.log(d.u_open("d")) / F.log(F.lit(1 - number("p", default=0.5)))).cast("double")
    elif name == "zipf":
        x = zipf(d, number("s", default=1)).cast("double")
    elif name == "bimodal":
        peaks = [float(v) for k, v in spec.named if k == "peaks"] or [0.0, 1.0]
        spread = max(abs(peaks[1] - peaks[0]) / 6, 0.1)
        x = F.when(d.u("side") < 0.5, normal(d, peaks[0], spread, "l")).otherwise(normal(d, peaks[1], spread, "r"))
    elif name in ("categorical", "weighted"):
        weights = [float(v) for _, v in spec.named] or [float(a) for a in spec.args[1:]]
        x = d.weighted([float(i) for i in range(len(weights))], weights, "d")
    else:
        raise ValueError(f"unknown distribution: {name}")
    return clamp(x, low, high)


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(float(low)))
    return x if high is None else F.least(x, F.lit(float(high)))
