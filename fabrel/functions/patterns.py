"""Pattern templates: SKU-{AA}-{0000}."""

from __future__ import annotations

import re
from datetime import UTC
from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rng import Draw

# The spelling alphabet, for {word} and {WORD}.
WORDS = (
    "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra "
    "tango uniform victor whiskey xray yankee zulu"
).split()
PLACEHOLDER = re.compile(r"\{([^{}]*)\}")


def uuid_of(text: Column) -> Column:
    """A version 4 UUID from the md5 of text."""
    h = F.md5(text)
    cut = lambda a, n: F.substring(h, a, n)
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(cut(17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-4"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def _base(text: Column, alphabet: str, n: int) -> Column:
    """n characters of an alphabet, two hex digits of the SHA-256 of text for each."""
    h = F.sha2(text, 256)
    return F.concat(*[F.substring(F.lit(alphabet), (F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int") % len(alphabet) + 1).cast("int"), F.lit(1)) for k in range(n)])


def ulid_of(text: Column, now) -> Column:
    """26 characters of Crockford's base 32: ten for the milliseconds of `now` (UTC), the others from text."""
    digits, left, head = "0123456789ABCDEFGHJKMNPQRSTVWXYZ", int(now.replace(tzinfo=UTC).timestamp() * 1000), ""
    for _ in range(10):
        left, k = divmod(left, 32)
        head = digits[k] + head
    return F.concat(F.lit(head), _base(text, digits, 16))


def cuid_of(text: Column) -> Column:
    """`c` and 24 characters in base 36 from text."""
    return F.concat(F.lit("c"), _base(text, "0123456789abcdefghijklmnopqrstuvwxyz", 24))


def _alphabet(slot: str) -> str | None:
    for letters, pattern in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A+"), ("abcdefghijklmnopqrstuvwxyz", "a+"), ("0123456789", "0+"), ("0123456789ABCDEF", "#+")):
        if re.fullmatch(pattern, slot):
            return letters
    return None


def slots(template: str) -> int:
    """How many texts the lettered placeholders can make."""
    n = 1
    for slot in PLACEHOLDER.findall(template):
        if letters := _alphabet(slot):
            n *= len(letters) ** len(slot)
        elif slot in ("word", "WORD"):
            n *= len(WORDS)
    return n


def is_template(text: str) -> bool:
    """Whether a pattern has placeholders of this module."""
    return any(_alphabet(slot) or slot in ("word", "WORD", "uuid", "seq") for slot in PLACEHOLDER.findall(text)) or (PLACEHOLDER.search(text) is not None and not re.search(r"\{\d+(,\d*)?\}", text))


def spread(d: Draw, total: int) -> Column:
    """A place in [0, total) for the row, different for any `total` rows in a row: a step without common divisor."""
    step = next(s for s in range(int(total * 0.618) | 1, 2 * total + 3) if gcd(s, total) == 1)
    place = (d.rid.cast("decimal(38,0)") * F.lit(step).cast("decimal(20,0)") + F.lit(d.seed % total).cast("decimal(20,0)")) % F.lit(total).cast("decimal(20,0)")
    return place.cast("long") if total < 1 << 62 else place


def expand(template: str, d: Draw, *, distinct: bool = False) -> Column:
    """The template with its placeholders filled; unknown ones stay.

    With distinct, the row number is spread over all texts by a step without common divisor, so that rows have
    different texts as long as there are enough: no shuffle is needed to make them unique.
    """
    total = slots(template)
    place = None
    if distinct and total > 1:
        place = spread(d, total)
    parts, at, used = [], 0, 1
    for i, m in enumerate(PLACEHOLDER.finditer(template)):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        slot = m[1]
        letters = _alphabet(slot)
        if letters or slot in ("word", "WORD"):
            size = len(letters) ** len(slot) if letters else len(WORDS)
            value = d.h(f"p{i}") % size if place is None else _div(place, used) % size
            used *= size
            if letters:
                base = len(letters)
                chars = [F.substring(F.lit(letters), (_div(value, base ** (len(slot) - 1 - k)) % base + 1).cast("int"), F.lit(1)) for k in range(len(slot))]
                parts.append(F.concat(*chars))
            else:
                words = WORDS if slot == "word" else [w.upper() for w in WORDS]
                parts.append(F.element_at(F.array(*[F.lit(w) for w in words]), (value + 1).cast("int")))
        elif slot == "uuid":
            parts.append(uuid_of(d.h(f"p{i}").cast("string")))
        elif slot == "seq":
            parts.append((d.rid + 1).cast("string"))
        else:
            parts.append(F.lit(m[0]))
    return F.concat(*parts, F.lit(template[at:]))


def _div(x: Column, n: int) -> Column:
    """Whole quotient of a number that is not negative."""
    return x if n == 1 else F.call_function("div", x, F.lit(n))
