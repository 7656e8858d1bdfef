"""Lists as numbered tables from which weighted rows are drawn by an alias table, one join for a draw."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import Draw
from ..storage import written
from .totals import numbered, running_sum

#: The weight of a row that nothing says the weight of.
WEIGHT = "weight"
#: The list and the column that semantic types draw from, where their names do not say it.
LISTED = {
    "person.first": ("given_names", "name"), "person.last": ("surnames", "name"), "address.city": ("cities", "name"), "address.state": ("cities", "region"),
    "address.country": ("cities", "country"), "geo.city": ("cities", "name"), "geo.country": ("cities", "country"), "geo.lat": ("cities", "latitude"), "geo.lng": ("cities", "longitude"),
    "job.title": ("occupations", "title"), "job.group": ("occupations", "group"), "company.name": ("companies", "name"), "product.category": ("product_categories", "name"),
    "geo.timezone": ("timezones", "name"), "currency.code": ("currencies", "code"), "currency.name": ("currencies", "name"),
}


def list_of(name: str, lists: Mapping[str, Sequence[str]]) -> tuple[str, str] | None:
    """The (list, column) of a semantic type among lists with their columns: a fixed one; a list that has the type's name, by its
    column `value`, `name` or its first one; or the list of the type's first word, by the column of its last."""
    if name in LISTED and LISTED[name][1] in lists.get(LISTED[name][0], ()):
        return LISTED[name]
    for own in (name, name.replace(".", "_")):
        if own in lists:
            return own, next((c for c in ("value", "name") if c in lists[own]), next(c for c in lists[own] if c != WEIGHT))
    head, _, last = name.partition(".")
    return (head, last) if last and last in lists.get(head, ()) else None


def located(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, total: int, n: int) -> DataFrame:
    """points joined with the one of `n` intervals [low, high) of [0, total) that holds each point. Intervals stand under the
    cells of an even grid that they touch, at most two for each of them in all, so this is a join on a cell."""
    cells = max(n, 1)
    cell = lambda c: F.call_function("div", F.col(c).cast("decimal(38,0)") * cells, F.lit(max(total, 1)).cast("decimal(38,0)"))
    last = F.call_function("div", (F.col(high) - 1).cast("decimal(38,0)") * cells, F.lit(max(total, 1)).cast("decimal(38,0)"))
    grid = intervals.withColumn("__cell", F.explode(F.sequence(cell(low), last)))
    inside = (F.col("__at_cell") == F.col("__cell")) & (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    return points.withColumn("__at_cell", cell(at)).join(grid, inside).drop("__cell", "__at_cell")


@dataclass(frozen=True)
class Dimension:
    """table: slot from 0 to n - 1, keep, own and other, rows of the list. A draw takes a slot and a number below `total`; the row
    is own if the number is below keep, else other."""

    table: DataFrame
    n: int
    total: int

    def drawn(self, rows: DataFrame, d: Draw, name: str) -> DataFrame:
        """rows with `name`, a row of the list drawn by weight. Spark broadcasts the list if it knows it to be small enough."""
        at, coin = F.col("__slot"), F.col("__coin")
        met = rows.withColumns({"__slot": d.h("slot") % self.n, "__coin": d.h("coin") % self.total}).join(self.table, at == F.col("slot"))
        return met.withColumn(name, F.when(coin < F.col("keep"), F.col("own")).otherwise(F.col("other"))).drop("__slot", "__coin", "slot", "keep", "own", "other")


def dimension(rows: DataFrame, weight: str = WEIGHT) -> Dimension | None:
    """The alias table of a list, by its column of weights (whole numbers; null, negative ones and none: as 0) or, if it has none,
    of equal weights; None for a list without weight.

    Slots are places in the order of the list's columns. A slot holds an n-th of all weight: rows of less have the rest of their
    slot filled by a row of more. By running sums: the gaps of the light rows, one behind the other, and the surpluses of the heavy
    ones lie on one line; a light row is filled by the heavy one whose surplus its gap begins in, and a heavy one that gave more than
    its surplus by the next. So the table comes from sums and interval joins, and no task goes through the list alone.
    """
    names = [c for c in rows.columns if c != weight]
    made = rows.select(*[F.col(f"`{c}`") for c in names], (F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0)) if weight in rows.columns else F.lit(1)).cast("long").alias("__w"))
    made = numbered(made.where("__w > 0"), [*[F.col(f"`{c}`") for c in names], F.col("__w")], "slot")
    made = written(made.select("slot", F.col("__w").alias("w"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("own")), "list")
    n, total = made.agg(F.count("*"), F.sum("w")).first()
    if not n:
        return None
    if n * total >= 1 << 62:
        raise ValueError(f"weights of {total} over {n} rows do not fit into 62 bits")
    share = F.col("w") * n
    light, gaps = running_sum(made.where(share < total).select("slot", (F.lit(total) - share).alias("gap")), ["slot"], F.col("gap"), "low")
    light = written(light.select("slot", "gap", "low", (F.col("low") + F.col("gap")).alias("high")), "light")
    heavy, _ = running_sum(made.where(share > total).select("slot", (share - total).alias("more")), ["slot"], F.col("more"), "low")
    heavy = numbered(heavy.select("slot", "low", (F.col("low") + F.col("more")).alias("high")), ["slot"], "place")
    heavy = written(heavy, "heavy")
    n_light, n_heavy = light.count(), heavy.count()
    giver = heavy.select(F.col("slot").alias("alias"), F.col("low").alias("from"), F.col("high").alias("to"))
    filled = located(light, "low", giver, "from", "to", gaps, n_heavy).select("slot", (F.lit(total) - F.col("gap")).alias("keep"), "alias")
    last = light.select(F.col("low").alias("from"), F.col("high").alias("to"))
    following = heavy.select((F.col("place") - 1).alias("place"), F.col("slot").alias("alias"))
    given = located(heavy.withColumn("end", F.col("high") - 1), "end", last, "from", "to", gaps, n_light)
    given = given.join(following, "place", "left").select("slot", (F.lit(total) + F.col("high") - F.col("to")).alias("keep"), "alias")
    alias = filled.unionByName(given)
    table = made.join(alias, "slot", "left").select("slot", F.coalesce("keep", F.lit(total)).alias("keep"), "own", F.coalesce("alias", "slot").alias("alias"))
    other = made.select(F.col("slot").alias("alias"), F.col("own").alias("other"))
    return Dimension(written(table.join(other, "alias").select("slot", "keep", "own", "other"), "dimension"), n, total)
