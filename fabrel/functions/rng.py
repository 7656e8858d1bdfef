"""Counter-based randomness: every draw is a pure function of seed, entity, field, row, salt and attempt."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are 52-bit, so that u = h / RANGE is exact in a double.
RANGE = float(1 << 52)


def hashed(text: Column) -> Column:
    """The first 13 hex digits of the md5 of text, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


@dataclass(frozen=True)
class Draw:
    """Draws for one field; rid is the row's number and attempt the try, both columns."""

    seed: int
    entity: str
    field: str
    rid: Column
    attempt: Column | None = None
    prefix: str = ""

    def sub(self, name: str) -> Draw:
        return replace(self, prefix=f"{self.prefix}{name}.")

    def h(self, salt: str = "") -> Column:
        attempt = F.lit(0) if self.attempt is None else self.attempt
        return hashed(F.concat_ws("|", F.lit(f"{self.seed}|{self.entity}|{self.field}"), self.rid.cast("string"), F.lit(self.prefix + salt), attempt.cast("string")))

    def u(self, salt: str = "") -> Column:
        """In [0, 1)."""
        return self.h(salt).cast("double") / F.lit(RANGE)

    def u_open(self, salt: str = "") -> Column:
        """In (0, 1)."""
        return (self.h(salt).cast("double") + 0.5) / F.lit(RANGE)

    def integer(self, low: int, high: int, salt: str = "") -> Column:
        """In [low, high]."""
        return F.lit(int(low)).cast("long") + self.h(salt) % F.lit(int(high) - int(low) + 1).cast("long")

    def pick(self, values: Sequence, salt: str = "") -> Column:
        return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (self.h(salt) % len(values) + 1).cast("int"))

    def chance(self, p: float, salt: str = "") -> Column:
        return self.u(salt) < F.lit(float(p))

    def weighted(self, values: Sequence, weights: Sequence[float], salt: str = "") -> Column:
        """The value in whose share of the cumulated weights u falls."""
        total, run = float(sum(weights)), 0.0
        u, out = self.u(salt), None
        for v, w in zip(values[:-1], weights[:-1], strict=True):
            run += w
            out = F.when(u < F.lit(run / total), F.lit(v)) if out is None else out.when(u < F.lit(run / total), F.lit(v))
        return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))
